import collections
import math
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stackwise.llm import rules as R
from stackwise.llm import sharding as S
from stackwise.llm import token_scan as T

from .conftest import SPACES

PATH = public_tokenizers.path("word_bpe_49k.json")


def base(t):
    t = t or ""
    w = SPACES.findall(t)
    lines = [x for x in t.split("\n") if SPACES.search(x)]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n, hit = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def test_base_counts_equal_brute_force(make_docs, corpus):
    r = random.Random(4)
    rows = list(corpus) + [(1000 + i, "\n".join(" ".join(r.choice(["a", "B#", "c|", "é*"]) for _ in range(r.randint(0, 14))) for _ in range(r.randint(1, 9)))) for i in range(60)]
    rows += [(2000, "a b c d e f g h a b c d e f g h"), (2001, "x " * 8), (2002, "x " * 9), (2003, "l\nl\n\n \n l\nl"), (2004, "é ñ 中文 \U0001F600 z")]
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in R.quality_rules(make_docs(rows)).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_distance_and_verdicts(spark, make_docs):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.1, 0.3, 0.6]
    got = spark.range(1).select(R.jensen_shannon(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt(sum(0.5 * x * math.log2(x / z) for v in (p, q) for x, z in zip(v, m) if x > 0))
    assert got == pytest.approx(want)
    r = random.Random(9)
    plain = lambda: " ".join(r.choice(["the", "of", "and", "to", "house", "tree", "river", "under", "letters", "garden"]) + r.choice(["", "", ","]) for _ in range(120)) + "."
    rows = [(i, plain()) for i in range(80)] + [(100, plain().upper()), (101, " ".join(f"{w}###" for w in plain().split())), (102, None), (103, "short but clean text"), (104, plain(), None)]
    kept = {x.doc_id: x.kept for x in R.quality_rules(make_docs(rows)).collect()}
    assert all(kept[i] for i in range(80)) and not kept[100] and not kept[101] and not kept[102] and not kept[103] and kept[104]
    assert R.quality_rules(make_docs([])).count() == 0


def test_clean_documents_of_the_corpus_stay(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = R.quality_rules(d).join(labels, "doc_id").toPandas()
    clean = got[(got.quality == 1) & ~got.base_failed]
    junk = got[got.quality == 0]
    assert clean.kept.mean() > 0.98 and junk.kept.mean() < 0.5


def brute_table(shards, size):
    order = [[(S._number(f"{s}#offset") % size + j * (S._number(f"{s}#skip") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    owner = {}
    while len(owner) < size:
        for i, o in enumerate(order):
            if len(owner) < size:
                owner[next(x for x in o if x not in owner)] = i
    return [owner[i] for i in range(size)]


def test_lookup_table_is_even_and_stable():
    shards = tuple(f"s{i}" for i in range(10))
    table = S.lookup_table(shards, 1009)
    assert table == brute_table(shards, 1009)
    n = collections.Counter(table)
    assert max(n.values()) - min(n.values()) <= 1
    fewer = S.lookup_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.25 * 1009
    with pytest.raises(ValueError):
        S.lookup_table(shards, 1000)


def test_placement(spark, make_docs, tmp_path):
    import hashlib

    rows = [(i, "t") for i in range(500)] + [(None, None), (None, ""), (7, "again")]
    df = make_docs(rows).selectExpr("*", "9 as slot", "'q' as shard")
    got = S.assign_shards(df, "doc_id").collect()
    table = S.lookup_table()
    for r in got:
        slot = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % S.SIZE
        assert (r.slot, r.shard) == (slot, S.SHARDS[table[slot]])
    assert len(got) == 503 and S.assign_shards(make_docs([]), "doc_id").count() == 0
    S.write_shards(make_docs(rows), "doc_id", str(tmp_path / "x"), files_per_shard=2)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 503


@pytest.mark.parametrize("block,run", [(1 << 16, 1024), (7, 3), (1, 1), (50, 2)])
def test_token_counts_equal_tokenizer(make_docs, corpus, block, run):
    tok = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in corpus if len(t or "") < 2000]
    blocks = T.token_blocks(make_docs(rows, 2), PATH, block_tokens=block)
    got = T.count_tokens(blocks, run_blocks=run).collect()
    want = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    assert sorted(r.n_tokens for r in got) == want and all(r.terminated for r in got)
    for f in {r.file for r in got}:
        own = sorted((r for r in got if r.file == f), key=lambda r: r.doc_index)
        assert [r.doc_index for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(q.n_tokens + 1 for q in own[:j]) for j in range(len(own))]


def test_raw_files_and_open_ends(spark, tmp_path):
    import struct

    streams = {"a": [5, 6, 2, 2, 7, 8, 9], "b": [2], "c": [], "d": [4, 4, 4, 4, 4], "e": [9, 2, 9, 9, 2]}
    for name, ids in streams.items():
        (tmp_path / f"{name}.bin").write_bytes(struct.pack(f"<{len(ids)}H", *ids))
    for block in (1, 2, 3, 100):
        got = T.count_tokens(T.file_blocks(spark, str(tmp_path), block_tokens=block), run_blocks=2).collect()
        by = collections.defaultdict(list)
        for r in sorted(got, key=lambda r: r.doc_index):
            by[r.file].append((r.start, r.n_tokens, r.terminated))
        assert sorted(by.values()) == sorted([[(0, 2, True), (3, 0, True), (4, 3, False)], [(0, 0, True)], [(0, 5, False)], [(0, 1, True), (2, 2, True)]])
    empty = spark.createDataFrame([(1, 0, None), (1, 1, bytearray(b""))], "file long, block long, ids binary")
    assert T.count_tokens(empty).count() == 0 and T.count_tokens(empty.limit(0)).count() == 0
