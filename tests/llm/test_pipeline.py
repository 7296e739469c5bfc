import os
import random

import pytest

import corpus_pipeline as C
from stackwise.llm.rules import quality_rules

from .test_decontaminate import brute as contaminated
from .test_jaccard import brute as components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small corpus: clean texts, toxic ones, junk, exact and near copies, benchmark passages, nulls and repeats."""
    r = random.Random(11)
    common = "the of and to in is that for it with".split()
    stems = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(700)]
    clean = lambda n: " ".join(r.choice(common) if r.random() < 0.35 else r.choice(stems) for _ in range(n))
    bench = [(i, clean(20)) for i in range(10)]
    docs, labels, kind = [], [], {}

    def add(text, what, toxic=0):
        i = len(docs)
        docs.append((i, text, "en", "s", None if text is None else len(text)))
        kind[i] = what
        labels.append((i, 1, toxic))
        return i

    for _ in range(300):
        add(clean(r.randint(80, 160)), "clean")
    for _ in range(60):
        add(clean(90) + " you idiot and loser " + clean(10), "toxic", 1)
    for _ in range(20):
        add(" ".join(w.upper() + "!!" for w in clean(90).split()), "junk")
        add("word " * 60, "junk")
    for i in range(10):
        add(docs[i][1], "copy")
        w = docs[i][1].split()
        w[len(w) // 2] = "changed"
        add(" ".join(w), "copy")
    for i in range(8):
        add(clean(60) + " " + bench[i][1] + " " + clean(30), "leak")
    add(None, "empty")
    add("", "empty")
    docs.append(docs[20])  # a row that repeats id and text
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, kind, bench


def test_every_stage(spark, sf, tmp_path):
    path, rows, kind, bench = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(C.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id for r in out.select("doc_id").collect()}
        if name != "packing":
            assert out.columns == COLUMNS and {(r.doc_id, r.text) for r in out.collect()} <= set(before.items())
        if name == "toxicity":
            assert after == {i for i in before if kind[i] != "toxic"}
        elif name == "quality_rules":
            assert after == {r.doc_id for r in quality_rules(docs).filter("kept").collect()}
            assert {i for i in before if kind[i] in ("clean", "copy", "leak")} <= after and not {i for i in after if kind[i] in ("junk", "empty")}
        elif name == "ngram_jaccard":
            groups = components(list(before.items()), 5, 80)
            assert sorted(r.doc_id for r in out.collect()) == sorted({label for _, label in groups.values()})  # one row each, the smallest id
        elif name == "decontamination":
            hit = {i for i, _, _, _, bad in contaminated(list(before.items()), bench) if bad}
            assert hit and after == set(before) - hit
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(C.TOKENIZER)
            assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()} == {
                i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before.items()}
        docs = out
    assert C.run(spark, path).count() == docs.count()


def test_empty_documents_table(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").filter("doc_id < 0")
    for name, stage in C.STAGES:
        assert stage(spark, docs, sf[0]).count() == 0


def test_null_ids_and_repeated_ids(spark, sf):
    path, rows, kind, _ = sf
    some = [r for r in rows if kind[r[0]] == "clean"][:40]
    odd = [(None, *some[0][1:]), (None, *some[0][1:]), (None, *some[1][1:]), (some[2][0], *some[3][1:]), *some[2:8]]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    near = C.near_duplicates(spark, docs, path).collect()
    assert sorted(r.text for r in near) == sorted({r[1] for r in odd})  # one row per group of equal texts
    for stage in (C.toxicity, C.decontamination):
        assert stage(spark, docs, path).count() == len(odd)


def test_columns_of_any_name_pass_through(spark, sf):
    """A column called like the internal key, in any case and with dots, keeps its values in every filtering stage."""
    path, *_ = sf
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("doc_id < 40 or text is null")
    odd = docs.selectExpr("*", "concat('keep ', doc_id) as _document_key", "1 as `_DOCUMENT_KEY_`", "2 as `a.b`")
    for _, stage in C.STAGES[:-1]:
        got = stage(spark, odd, path)
        assert got.columns == odd.columns
        rows = got.collect()
        assert rows and all(r["_document_key"] == f"keep {r.doc_id}" and r["a.b"] == 2 for r in rows if r.doc_id is not None)


def test_run_keeps_only_what_its_result_reads(spark, sf, tmp_path):
    from stackwise.session import scratch_run

    path, *_ = sf
    with scratch_run(spark) as folder:
        pieces = C.run(spark, path)
        assert pieces.count() > 0
        local = folder.removeprefix("file:")
        left = [f for f in os.listdir(local) if not f.startswith(".")]
        assert len(left) == 1 and left[0].startswith("stage-decontamination")
    assert not os.path.exists(local)
