"""Language identification: languages from the documents, unknown pages, and the fusion against plain arithmetic."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stackwise.llm import langid as G

PARTS = {"it": "che lo gli zza ione are ggio sono delle quando", "xx": "kwrt zxpf gvmk qttr ðþ bnkl rrzt wwpk hjkl xcvb"}


def words(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(PARTS[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("pages", "documents"))


def test_a_fifth_language_is_learnt_and_a_page_of_none_is_not_claimed(spark, tables):
    pages, docs = tables
    more = spark.createDataFrame([(words("it", 300, i), "it") for i in range(40)] + [("junk", "q"), (None, None), ("x", " ")], "text string, lang string")
    docs = docs.select("text", "lang").union(more)
    assert G.document_languages(docs) == ("de", "en", "es", "fr", "it", "q")  # 1 of 243 documents is more than one in a thousand
    new = [(-1, "https://casa.it/a", f"<p>{words('it', 60, 99)}</p>"), (-2, "https://h.example/", f"<html lang='en'><p>{words('xx', 80, 5)}</p>"), (-3, "https://h.example/", f"<p>{words('xx', 4, 5)[:30]}</p>")]
    rows = pages.select("page_id", "url", "html").union(spark.createDataFrame(new, "page_id long, url string, html string"))
    out = {r.page_id: r for r in G.identify(rows, docs).collect()}
    assert (out[-1].lang, out[-1].text_lang) == ("it", "it") and out[-1].score > 0.9
    assert (out[-2].lang, out[-2].text_lang, out[-2].score, out[-2].declared) == ("und", "und", 0.0, "en")
    assert out[-3].lang != "und"  # too short to say
    assert sum(r.lang == "und" for r in out.values()) == 1
    without = {r.page_id: r.lang for r in G.identify(rows, tables[1]).collect()}
    assert without[-1] == "und"


def test_fusion_equals_plain_arithmetic(spark, tables):
    pages, docs = tables
    pages = pages.select("page_id", F.when(F.col("page_id") % 9 == 0, F.lit(None)).otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 11 == 0, F.lit("")).otherwise(F.col("html")).alias("html"))
    langs = G.document_languages(docs)
    model, highest = G.language_model(docs, languages=langs)
    least = G.usual_fit(docs, highest, languages=langs)
    k = len(langs)
    rows = G.text_posteriors(pages, model, highest, least, languages=langs).collect()

    def softmax(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    p = {r.page_id: [0.0] * k if r.far else softmax(r.logs) for r in rows}

    def total(keep):
        return [sum(p[r.page_id][j] for r in rows if keep(r)) for j in range(k)]

    mean = lambda own, weight, parent: [(o + weight * q) / (sum(own) + weight) for o, q in zip(own, parent)]
    every = total(lambda r: True)
    overall = [(x + 1) / (sum(every) + k) for x in every]
    said = {d: total(lambda r, d=d: r.declared == d) for d in langs}
    spoken = [sum(said[d][j] for d in langs) for j in range(k)]
    want = {}
    for r in rows:
        prior = overall
        if r.host is not None:
            suffix = mean(total(lambda x: x.suffix == r.suffix), G.SUFFIX_WEIGHT, overall)
            own = [max(h - q, 0) for h, q in zip(total(lambda x: x.host == r.host), p[r.page_id])]
            prior = mean(own, G.HOST_WEIGHT, suffix)
        else:
            prior = mean([0.0] * k, G.HOST_WEIGHT, overall)
        logs = [x + math.log(q) for x, q in zip(r.logs, prior)]
        if r.declared:
            true = [G.DECLARED_TRUE if l == r.declared else (1 - G.DECLARED_TRUE) / (k - 1) for l in langs]
            logs = [x + math.log((said[r.declared][j] + G.DECLARED_WEIGHT * true[j]) / (spoken[j] + G.DECLARED_WEIGHT)) for j, x in enumerate(logs)]
        post = softmax(logs)
        want[r.page_id] = ("und", 0.0) if r.far else (langs[max(range(k), key=lambda j: (post[j], langs[j]))], max(post))
    got = {r.page_id: (r.lang, r.score) for r in G.identify(pages, docs).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9


def test_usual_fit_is_a_tenth_of_the_mean(spark):
    docs = spark.createDataFrame([(words("it", n, n), "it") for n in (40, 80, 200, 1)] + [("short", "en"), (words("xx", 90, 1), None)], "text string, lang string")
    model, highest = G.language_model(docs, languages=("en", "it"))
    assert np.array_equal(highest, model[1])  # the other language is hardly known
    assert G.usual_fit(docs.filter("lang = 'en'"), highest, languages=("en", "it")) == -math.inf
    few = docs.filter("length(text) < 50")
    assert G.usual_fit(few, G.language_model(few, languages=("en", "it"))[1], languages=("en", "it")) == -math.inf
    fits = []
    for n in (40, 80, 200):
        for _, _, data, offsets in G.TS.text_slices(pa.array([words("it", n, n)])):
            fits.append(highest[G._trigrams(data, offsets)[1]].mean())
    least = G.usual_fit(docs, highest, languages=("en", "it"))
    assert abs(least - (np.mean(fits) - math.log(G.UNUSUAL))) < 1e-4
