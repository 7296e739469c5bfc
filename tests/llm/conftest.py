import random
import re

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s or "")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, parts=3):
        """rows: (doc_id, text) or (doc_id, text, lang); adds a column that clashes with names inside the operators."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        return df.selectExpr("*", "1 as row", "2 as n", "'x' as label", "'y' as ids", "3 as cls", "4 as block", "'z' as h")
    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, empty, null and long ones."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 7))) for _ in range(400)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, passage = [], words(25)
    for i in range(60):
        rows.append(words(r.randint(1, 120)))
    for i in range(20):
        rows.append(words(10) + passage + words(10))
    base = words(80)
    for i in range(40):
        copy = list(base)
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = r.choice(vocab)
        rows.append(copy)
    texts = [" ".join(w) for w in rows]
    texts += [texts[0], texts[70].upper(), texts[90].replace(" ", "\n"), "", None, "  \n ", "one", "One", "one two three", "É é É", " ".join(words(30000))]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]
