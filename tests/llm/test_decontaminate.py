import random
import re

import pytest

from stackwise.llm import decontaminate as D

from .conftest import lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, span=10):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add(None if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, ids = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    ids |= wins[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), tuple(sorted(ids - {None})), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [1, 5, 10])
def test_report_equals_brute_force(spark, make_docs, k):
    r = random.Random(k)
    word = lambda: r.choice(["ab", "cd", "ef", "Gh", "ñu", "12"])
    items = [(i, " ".join(word() for _ in range(r.choice([3, 9, 10, 11, 25])))) for i in range(30)] + [(77, None), (78, ""), (79, "..."), (None, "zz yy xx"), (5, "ab cd ab"), (5, "q")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(r.randint(0, 40))]
        if r.random() < 0.6:
            w += (r.choice(items)[1] or "").split()
        docs.append((i, r.choice([" ", ", ", "\n", "--"]).join(w)))
    docs += [(100, None), (100, ""), (101, "zz yy xx"), (101, "zz, YY xx"), (102, " ".join(word() for _ in range(20000))), (None, "q")]
    got = D.contamination(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), k=k)
    assert sorted(((x.doc_id, x.n_words, x.n_hit, tuple(x.item_ids), x.contaminated) for x in got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(make_docs([]), none).count() == 0
    assert [r.n_hit for r in D.contamination(make_docs([(1, "a b c")]), none).collect()] == [0]
