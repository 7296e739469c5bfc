"""Quality, toxicity, language and licence models: held-out accuracy and defined cases."""
import random
import re
import textwrap
import zlib

import numpy as np
import pytest

from stackwise.llm import langid as G
from stackwise.llm import licences as N
from stackwise.llm import quality as Q
from stackwise.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def fold(i, of):
    return zlib.crc32(str(i).encode()) % of


def test_quality_on_held_out_documents(spark):
    labels = table(spark, "labels")
    got = Q.quality_scores(table(spark, "documents"), labels).toPandas().merge(labels.toPandas(), on="doc_id", how="left")
    assert len(got) == 1000 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [fold(i, 4) == 2 for i in got.doc_id]).all()
    held = got[got.held_out & got.quality.notna()]
    assert (held.predicted == held.quality).mean() > 0.9


def test_held_out_labels_do_not_matter(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality",
                               "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    for f in (Q.quality_scores, X.toxicity_scores):
        a, b = (sorted((r.doc_id, r.predicted, round(r.score, 9)) for r in f(docs, x).collect()) for x in (labels, turned))
        assert a == b


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    d = len(Q.FEATURES)
    x = [rng.normal(size=(400, d)) @ rng.normal(size=(d, d)) + c for c in (0, 2)]
    m = Q.Discriminant([len(v) for v in x], np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), shrink=0.0, diagonal=0.0, floor=0.0)
    want = []
    for v in x:
        mean, cov = v.mean(0), np.cov(v.T, bias=True)
        z = x[0] - mean
        want.append(np.log(len(v)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    assert np.allclose(m.margin(x[0]), want[1] - want[0], rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("f,col", [(Q.quality_scores, "quality"), (X.toxicity_scores, "toxic")])
def test_defined_cases_of_scores(spark, make_docs, f, col):
    rows = [(None, "a b"), (1, None), (1, ""), (2, "good words here"), (2, "good words here"), (3, "x" * 200000 + " y")]
    one = spark.createDataFrame([(2, 1), (2, 1), (3, None), (99, 0)], f"doc_id long, {col} int")
    for labels in (one, one.limit(0)):
        got = f(make_docs(rows), labels).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert f(make_docs([]), one).count() == 0


def test_toxicity_on_held_out_documents(spark):
    labels = table(spark, "labels")
    got = X.toxicity_scores(table(spark, "documents"), labels).toPandas().merge(labels.toPandas(), on="doc_id", how="left")
    assert (got.held_out == [fold(i, 3) == 1 for i in got.doc_id]).all()
    held = got[got.held_out & got.toxic.notna()]
    assert held[held.toxic == 1].predicted.mean() > 0.7 and held[held.toxic == 0].predicted.mean() < 0.02


def test_restoration(spark, make_docs):
    model = X.character_model(table(spark, "documents"))
    r = X.Restorer(model)
    for seen, want in {"tr4sh": "trash", "p4th3tic": "pathetic", "1d10t": "idiot", "l0ser!!": "loser", "$cum": "scum", "traaaash": "trash", "l.o.s.e.r": "loser", "IDIOT!": "idiot",
                       "l o s e r": "loser", "That***": "that"}.items():
        assert r.text(seen) == want
    got = X.restored_text(make_docs([(1, "You L0SER, plain the. l o s e r"), (2, None), (3, "")]), model).collect()
    assert {x.doc_id: x.restored for x in got} == {1: "you loser plain the. loser", 2: None, 3: ""}


def test_obfuscated_words_score_like_plain_ones(spark, make_docs):
    r = random.Random(5)
    words = "the of and then erat onhe tion".split()
    docs, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        docs.append((i, " ".join(r.choice(words) for _ in range(30)) + (" idiot loser" if bad else "")))
        labels.append((i, int(bad)))
    docs += [(1000, "the of 1d10t and l o s e r"), (1001, "the of and then erat onhe")]
    got = {x.doc_id: x.predicted for x in X.toxicity_scores(make_docs(docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[1000] == 1 and got[1001] == 0


def brute_viterbi(model, slots):
    best = {"": 0.0}
    for s in slots:
        best = {t + c: v + w for t, v in best.items() for c, w in s}
    def score(t):
        total, h = 0.0, (0, 0, 0)
        for ch in t + " ":
            x = model.symbol(ch)
            if x == 0 and ch != " ":
                h = (0, 0, 0)
                continue
            total += float(model.log_p[h[0], h[1], h[2], x])
            h = (h[1], h[2], x) if x else (0, 0, 0)
        return total
    return max(v + score(t) for t, v in best.items()), {t: v + score(t) for t, v in best.items()}


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    model = X.CharacterModel(rng.integers(0, 50, X.SYMBOLS ** X.ORDER))
    for token in ("1d1ot", "a-b-c", "aaab1", "s t u p", "$5x!a"):
        top, all_ = brute_viterbi(model, X.lattice(token))
        got = model.restore(X.lattice(token))
        assert max(v for t, v in all_.items() if t.strip() == got) == pytest.approx(top, abs=1e-4)


def test_language_of_pages(spark):
    pages = table(spark, "pages")
    got = G.identify(pages, table(spark, "documents")).toPandas().merge(pages.toPandas(), on="page_id")
    want = got.url.str.extract(r"//[^/]+/([a-z]{2})/")[0]
    assert len(got) == pages.count() and (got.lang == want)[want.notna()].mean() > 0.97


def test_language_cases(spark):
    schema = "page_id long, url string, html string, lang string, host int"
    rows = [(1, "https://h.de/x", "<html lang='de'><p>der die und das</p>", "x", 1), (2, None, None, None, None), (2, "not an address", "", None, 1), (None, "http://u@H.De:80/", "<html><script>the the</script>", None, 2),
            (4, "https://h.de/", "<html lang=xx><p>" + "und der " * 50000, None, 3)]
    docs = spark.createDataFrame([("der die das und ist nicht", "de"), ("the of and to in is not", "en"), (None, "fr"), ("q", None), ("zz", "tlh")], "text string, lang string")
    out = G.identify(spark.createDataFrame(rows, schema), docs).collect()
    got = {(r.page_id, r.host): r for r in out}
    assert len(out) == 5 and got[(1, "h.de")].lang == got[(4, "h.de")].lang == "de" and got[(1, "h.de")].declared == "de" and got[(4, "h.de")].declared is None
    assert (None, "h.de") in got and all(0 < r.score <= 1 for r in got.values())
    assert G.identify(spark.createDataFrame([], schema), docs).count() == 0 and G.identify(spark.createDataFrame(rows, schema), docs.limit(0)).count() == 5


def test_licences_of_paragraphs(spark, make_docs):
    rows = [(1, "Intro text.\nReleased under the MIT License.\nMore."), (2, "Licensed under the Apache License, Version 2.0."), (3, "you need a license to drive a bus"), (4, None), (5, ""),
            (6, "a b c\nd"), (6, "LICENSED UNDER CC BY-NC 4.0.\n\nThis work is licensed under the GNU General Public License, version 3."), (None, "Released under the MIT License."),
            (8, "word " * 50000 + "\nAll rights reserved."), (9, "this licence forbids nothing that the moon allows")]
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in N.scan_licences(make_docs(rows)).collect()}
    assert got == {(1, 1): ("mit", True), (2, 0): ("apache-2.0", True), (3, 0): ("unknown", False), (6, 0): ("cc-by-nc", True), (6, 2): ("gpl", True), (None, 0): ("mit", True),
                   (8, 1): ("proprietary", True), (9, 0): ("unknown", False)}
    assert N.scan_licences(make_docs([])).count() == 0


def test_licences_of_the_corpus(spark):
    docs = table(spark, "documents")
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    line = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
            "gpl": "This work is licensed under the GNU General Public License, version 3."}
    want = {(i, n, f) for i, t in text.items() for n, p in enumerate(t.split("\n")) for f, x in line.items() if p == x}
    got = {(r.doc_id, r.paragraph, r.family) for r in N.scan_licences(docs).collect() if r.confirmed}
    assert want and got >= want and all(re.search(N.ANCHORS, text[i].split("\n")[n], re.I) for i, n, _ in got)


def test_long_anchored_lines_are_exploded_without_their_words(spark, make_docs):
    line = "Licensed under the MIT license. " + " ".join(f"w{i}x" for i in range(50000))
    got = N.scan_licences(make_docs([(1, line), (2, "Licensed under the MIT license.")])).collect()
    assert {(r.doc_id, r.paragraph) for r in got} == {(1, 0), (2, 0)} and all(r.family == "mit" and r.confirmed for r in got)
    units = spark.createDataFrame([(1, ["a", "b"])], "row long, words array<string>")
    model = spark.createDataFrame([("a b", 1.0)], "g string, w0 double")
    sums = N.class_sums(units, model, 1)
    assert [tuple(r) for r in sums.collect()] == [(1, 1, 1.0)] and set(sums.columns) == {"row", "n", "z0"}


def wrap(text, width):
    return textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)


@pytest.mark.parametrize("width", [20, 40, 72, 80])
def test_wrapped_licences(spark, make_docs, width):
    mit, bsd, gpl, apache = N.TEMPLATES["mit"][3], N.TEMPLATES["bsd"][0], N.TEMPLATES["gpl"][3], N.TEMPLATES["apache-2.0"][1]
    real = mit.replace("documentation files", 'documentation files (the "Software")') + ", including without limitation the rights to use, copy, modify and merge"
    cases = {1: ("mit", mit), 2: ("bsd", bsd), 3: ("gpl", gpl), 4: ("apache-2.0", apache), 5: ("mit", real)}
    docs = [(i, "The moon rose.\n\n" + "\n".join(wrap(t, width)) + "\n\nThe end.") for i, (_, t) in cases.items()]
    docs += [(i + 10, "#!/bin/sh\n#\n" + "\n".join("# " + x for x in wrap(t, width)) + "\n#\nmake all\n") for i, (_, t) in cases.items()]
    docs += [(i + 20, "\n".join(wrap("The rain fell on the hills and the boats stayed in the harbour all day. " + t + " Nobody knew when the wind would turn.", width))) for i, (_, t) in cases.items()]
    got = {}
    for r in N.scan_licences(make_docs(docs)).filter("confirmed").collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, r.confirmed))
    for i, (family, _) in cases.items():
        assert got[i] == got[i + 10] == [(2, family, True)]
        assert [(f, c) for _, f, c in got[i + 20]] == [(family, True)]


def test_licences_without_an_anchor_word(spark, make_docs):
    rows = [(1, "Text: CC BY 4.0"), (2, "CC0 1.0 Universal"), (3, "a b\nCC BY-NC 4.0\nc"), (4, "all\nrights\nreserved"), (5, "version 4.0 came by rail"), (6, "Creative\nCommons Attribution 4.0\nInternational\n\nThis work is licensed under a"),
            (7, "Released under the\nMIT License.\nReleased under the MIT License.\nReleased under the MIT License."), (8, "under the bridge he had released\nthe fish without any license")]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in N.scan_licences(make_docs(rows)).collect() if r.confirmed)
    assert got == [(1, 0, "cc-by"), (2, 0, "cc0"), (3, 1, "cc-by-nc"), (4, 0, "proprietary"), (7, 0, "mit"), (7, 2, "mit"), (7, 3, "mit")]


def test_no_confirmed_licence_lacks_a_cover_word():
    r = random.Random(3)
    for texts in N.TEMPLATES.values():
        for t in texts:
            words = sorted(set(N.plain_words(t)))
            for _ in range(50):
                held = r.sample(words, -(-7 * len(words) // 10))
                assert re.search(N._COVERED, " ".join(held))


def test_obfuscated_words_beside_marks(spark, make_docs):
    model = X.character_model(table(spark, "documents"))
    seen = {1: ("you s c u m.", "scum"), 2: ("you s c u m! go", "scum"), 3: ('a "$cum" here', "scum"), 4: ("the (1diot) said", "idiot"), 5: ("you (l o s e r), go", "loser"), 6: ("well, s c u m", "scum")}
    got = {r.doc_id: r.restored for r in X.restored_text(make_docs([(i, t) for i, (t, _) in seen.items()]), model).collect()}
    for i, (_, want) in seen.items():
        assert want in got[i].split()
    r = random.Random(6)
    words = "the of and then erat onhe tion".split()
    docs = [(i, " ".join(r.choice(words) for _ in range(30)) + ("" if i % 5 else " idiot" if i % 2 else " scum")) for i in range(900)]
    docs += [(1000 + i, "the of and " + t) for i, t in enumerate(['"$cum" then', "s c u m!", "(1diot) of the", "s c u m."])] + [(2000, "the (of) and. a, b")]
    score = {x.doc_id: x.predicted for x in X.toxicity_scores(make_docs(docs), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)], "doc_id long, toxic int")).collect()}
    assert all(score[1000 + i] == 1 for i in range(4)) and score[2000] == 0


@pytest.mark.parametrize("of,noise,quoted", [(2, 0.013, 0.0), (5, 0.03, 0.0), (5, 0.0, 0.004)])
def test_toxicity_with_balanced_noisy_and_quoting_labels(spark, make_docs, of, noise, quoted):
    r = random.Random(8)
    words, insults = "the of and then erat onhe tion".split(), ["idiot", "loser", "scum", "trash"]
    docs, labels, toxic = [], [], {}
    for i in range(3000):
        bad = toxic[i] = i % of == 0
        held = r.sample(insults, 2) if bad else [w for w in insults if r.random() < quoted]
        docs.append((i, " ".join([r.choice(words) for _ in range(30)] + held)))
        labels.append((i, int(bad != (r.random() < noise))))
    got = X.toxicity_scores(make_docs(docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(x.predicted, toxic[x.doc_id]) for x in got if x.held_out]
    assert sum(p for p, t in held if t) > 0.95 * sum(t for _, t in held) and sum(p for p, t in held if not t) < 0.02 * len(held)
