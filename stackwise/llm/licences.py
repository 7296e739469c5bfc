"""Operator 10: licence scan by a trained paragraph classifier, in DataFrame functions only.

1. *Candidates.* A unit is a line, or a run of lines without a blank one between them, as notices are often wrapped.
   A text is split if it holds an anchor word (licence, copyright, warranty, ...) or one of the ``COVER`` words, without
   which no unit holds enough of a template to be confirmed. Runs are as long as a notice can be, wherever in a line it
   begins or ends, and are scored if they hold enough of a template, a share of ``ORDERED`` of its word pairs with it.
2. *Classifier.* Multinomial logistic regression over the 1- to 3-word grams of the templates, kept sparse by
   soft thresholds. Training rows are the templates, general sentences that speak of licences without being
   one, and a bounded sample of corpus lines that are no candidates (``SAMPLE`` rows, lowest hashes),
   so the fit costs the same for any corpus. Scoring joins the exploded grams with the broadcast weights.
3. *Unknown class.* Probabilities are sharpened or flattened by a temperature that makes the training labels
   likeliest; below ``KNOWN`` or with "none" on top, a line with an anchor is ``unknown``.
4. *Confirmation.* The unit must hold a share of ``CONFIRM`` of the words of one of the family's templates;
   else the family is reported as not confirmed.
5. *Report.* One row per line with an anchor, and one per confirmed notice without one or of several lines, under its
   first line. Of confirmed units of a family that overlap by more than one line the one that holds most words of a
   template, then the shortest, is the notice, and its lines have no other row unless they are confirmed as another family.

Defined cases: null and empty texts have no lines; a line of any length is one row; repeated rows
and lines are reported each; a table without candidates or without rows gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackwise.llm.shared import written

#: Notices by licence family.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 2", "SPDX-License-Identifier: GPL-3.0-or-later",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal public domain dedication"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying or redistribution is prohibited."],
}
#: Sentences that speak of licences without granting one.
GENERAL = ["You need a license to drive a car.", "The license fee must be paid every year.", "He lost his fishing licence last week.", "Ask the teacher for permission before you leave.",
           "The warranty of the phone has expired.", "The copyright dispute was settled in court.", "Please renew your software license soon.", "The word license has two spellings.",
           "A new version of the software was released.", "Permission was denied by the office.", "The Apache helicopter landed.", "She studied at MIT for four years.",
           "The public domain is a legal notion.", "The redistribution of wealth is debated."]
ANCHORS = r"licen[cs]|copyright|warrant|permission|redistribut|spdx|public domain|rights reserved|creative commons|source code form"
NONE, UNKNOWN = "none", "unknown"
SAMPLE = 200      # corpus lines that are no candidates in the training rows
STEPS, RATE, RIDGE, SHRINK = 200, 20.0, 1e-4, 2e-4
KNOWN, CONFIRM, ORDERED = 0.6, 0.7, 0.5


def plain_words(text: str) -> list[str]:
    """The words of a template, as ``_clean(_words(text))`` has them."""
    words = (w.strip(".-") for w in re.sub(r"[^a-z0-9+.\-]+", " ", text.lower()).split(" "))
    return [w for w in words if w]


def _cover() -> list[str]:
    """Of each template so many of its longest words that a share of CONFIRM of its words holds one of them."""
    out = set()
    for t in (set(plain_words(t)) for texts in TEMPLATES.values() for t in texts):
        out.update(sorted(t, key=lambda w: (-len(w), w))[:len(t) - math.ceil(CONFIRM * len(t)) + 1])
    return sorted(out)


COVER = _cover()
_COVERED = r"(?<![a-z0-9+])(?:" + "|".join(re.sub(r"([.+\-])", r"\\\1", w) for w in COVER) + r")(?![a-z0-9+])"
#: Words of a run before its second and after its last line break: as many as the longest notice that can be confirmed.
REACH = math.ceil(max(len(plain_words(t)) for texts in TEMPLATES.values() for t in texts) / CONFIRM)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9+.\-]+", " "), " "), lambda w: F.regexp_replace(w, r"[.\-]+$", "") != "")


def _clean(words: Column) -> Column:
    return F.transform(words, lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", ""))


def ngrams(words: str) -> Column:
    """Distinct 1- to 3-word grams of a word array column."""
    n = F.size(words)
    word = lambda at: F.get(F.col(words), at)
    none = F.array().cast("array<string>")
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", word(i), word(i + 1)))).otherwise(none)
    triples = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", word(i), word(i + 1), word(i + 2)))).otherwise(none)
    return F.array_distinct(F.concat(F.col(words), pairs, triples))


def _frame(spark: SparkSession) -> DataFrame:
    """(label, text) of the templates and the general sentences."""
    rows = [(family, t) for family, texts in TEMPLATES.items() for t in texts] + [(NONE, t) for t in GENERAL]
    array = F.array(*(F.struct(F.lit(a).alias("label"), F.lit(b).alias("text")) for a, b in rows))
    return spark.range(1).select(F.explode(array).alias("r")).select("r.label", "r.text")


def _anchored(text: str) -> Column:
    return F.col(text).rlike(f"(?i){ANCHORS}")


def _candidate(text: str) -> Column:
    return _anchored(text) | F.lower(F.col(text)).rlike(_COVERED)


def lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, doc_id, line, anchored, candidate, words) of the lines of every text with a candidate; the whole text is searched first, so most texts are never split."""
    hit = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).filter(_candidate("_text")).withColumn("doc", F.monotonically_increasing_id())
    rows = hit.select("doc", "doc_id", F.posexplode(F.split("_text", "\n")).alias("line", "text"))
    return rows.select("doc", "doc_id", "line", _anchored("text").alias("anchored"), _candidate("text").alias("candidate"), _clean(_words(F.col("text"))).alias("words"))


def runs(rows: DataFrame) -> DataFrame:
    """(doc, doc_id, line, last, words) of the runs of lines that hold enough of a template: of the first line the last REACH words, of the last line the first."""
    behind = Window.partitionBy("doc").orderBy("line").rowsBetween(1, REACH)
    short = rows.select("doc", "doc_id", "line", "candidate", F.slice("words", 1, REACH).alias("head"), F.size("words").alias("n"),
                        F.when(F.size("words") > REACH, F.slice("words", -REACH, REACH)).otherwise(F.col("words")).alias("tail"))
    near = F.max(F.col("candidate").cast("int")).over(Window.partitionBy("doc").orderBy("line").rowsBetween(0, REACH))
    ahead = short.withColumn("near", near).withColumn("ahead", F.collect_list(F.struct("head", "n")).over(behind)).filter("n > 0 and near = 1 and size(ahead) > 0")
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("words"), F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def add(acc, x):
        joined = F.concat(acc["words"], x["head"])
        more = F.struct(joined.alias("words"), F.concat(acc["cuts"], F.array(F.size(joined))).alias("cuts"), (acc["n"] + x["n"]).alias("n"), (acc["n"] + x["n"] < REACH).alias("open"))
        shut = F.struct(acc["words"].alias("words"), acc["cuts"].alias("cuts"), acc["n"].alias("n"), F.lit(False).alias("open"))
        return F.when(acc["open"] & (x["n"] > 0), more).otherwise(shut)

    joined = ahead.select("doc", "doc_id", "line", "tail", F.aggregate("ahead", start, add).alias("r"))
    longest = joined.select("doc", "doc_id", "line", "tail", "r.words", "r.cuts", F.concat("tail", "r.words").alias("all")).filter((F.size("cuts") > 0) & _enough("all"))
    each = longest.select("doc", "doc_id", "line", "tail", "words", F.posexplode("cuts").alias("i", "cut"))
    cut = each.select("doc", "doc_id", "line", (F.col("line") + F.col("i") + 1).alias("last"), F.concat("tail", F.slice("words", F.lit(1), F.col("cut"))).alias("words"))
    return cut.filter(_enough("words"))


def _plain_sample(docs: DataFrame, text_col: str) -> DataFrame:
    plain = docs.select(F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("text")).filter(~_candidate("text") & F.col("text").rlike(r"\S"))
    return plain.orderBy(F.xxhash64("text"), "text").limit(SAMPLE).select(F.lit(NONE).alias("label"), "text")


def fit(spark: SparkSession, docs: DataFrame, *, text_col: str = "text") -> tuple[dict, dict, float]:
    """(weights by n-gram and class, intercepts, temperature) from the bounded training rows."""
    classes = [*TEMPLATES, NONE]
    rows = _frame(spark).union(_plain_sample(docs, text_col))
    grams = rows.select("label", F.monotonically_increasing_id().alias("row"), _clean(_words(F.col("text"))).alias("words")).select("row", "label", ngrams("words").alias("grams"))
    features = set()
    train = []
    rows_ = grams.collect()  # bounded: templates, sentences and SAMPLE paragraphs
    wanted = {g for r in rows_ if r["label"] != NONE for g in r["grams"]}
    for r in rows_:
        own = [g for g in r["grams"] if g in wanted]
        features.update(own)
        train.append((classes.index(r["label"]), own))
    k = len(classes)
    weights = {g: [0.0] * k for g in features}
    bias = [0.0] * k
    size = [sum(1 for y, _ in train if y == c) for c in range(k)]
    each = [1.0 / (k * n) if n else 0.0 for n in size]  # classes count alike
    logits = lambda own: [bias[c] + sum(weights[g][c] for g in own) / math.sqrt(max(len(own), 1)) for c in range(k)]

    def softmax(z):
        top = max(z)
        e = [math.exp(v - top) for v in z]
        s = sum(e)
        return [v / s for v in e]

    for _ in range(STEPS):
        grad, gb = {g: [0.0] * k for g in features}, [0.0] * k
        for y, own in train:
            p = softmax(logits(own))
            scale = each[y] / math.sqrt(max(len(own), 1))
            for c in range(k):
                d = p[c] - (c == y)
                gb[c] += each[y] * d
                for g in own:
                    grad[g][c] += scale * d
        for g, w in weights.items():
            for c in range(k):
                v = w[c] - RATE * (grad[g][c] + RIDGE * w[c])
                w[c] = math.copysign(max(abs(v) - RATE * SHRINK, 0.0), v)  # soft threshold: sparse weights
        for c in range(k):
            bias[c] -= RATE / 5 * gb[c]
    best = (math.inf, 1.0)
    for t in (2.0 ** (i / 4) for i in range(-12, 13)):
        loss = -sum(each[y] * math.log(max(softmax([v / t for v in logits(own)])[y], 1e-12)) for y, own in train)
        best = min(best, (loss, max(t, 0.25)))
    return {g: w for g, w in weights.items() if any(w)}, dict(zip(classes, bias)), best[1]


def _weights(spark: SparkSession, weights: dict, k: int) -> DataFrame:
    """(g, w0, w1, ...): the model's weights, a table of the training rows' size, from one literal."""
    text = "\n".join(g + "\t" + ",".join(repr(float(v)) for v in w) for g, w in sorted(weights.items()))
    rows = spark.range(1).select(F.explode(F.split(F.lit(text), "\n")).alias("row")).select(F.split("row", "\t").alias("row"))
    return rows.select(F.col("row")[0].alias("g"), F.split(F.col("row")[1], ",").alias("w")).select("g", *(F.col("w")[c].cast("double").alias(f"w{c}") for c in range(k)))


def class_sums(units: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """(row, n, z0, z1, ...): weighted n-grams of each unit of (row, words) and their summed weights; a row that is exploded holds one n-gram and no words."""
    grams = units.select("row", ngrams("words").alias("grams")).select("row", F.explode("grams").alias("g")).join(F.broadcast(model), "g")
    return grams.groupBy("row").agg(F.count("*").alias("n"), *(F.sum(f"w{c}").alias(f"z{c}") for c in range(k)))


def _literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _shared(own: Column, template: str) -> Column:
    words = list(dict.fromkeys(plain_words(template)))
    return F.size(F.array_intersect(own, _literal(words))) / F.lit(len(words))


def _ordered(pairs: Column, template: str) -> Column:
    words = plain_words(template)
    own = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
    return F.size(F.array_intersect(pairs, _literal(own))) >= math.ceil(ORDERED * len(own))


def _alike(words: str, pairs: Column | None = None) -> Column:
    """Per family the largest share of a template's words; with ``pairs`` only of templates whose words stand in order."""
    own = F.array_distinct(words)
    share = lambda t: _shared(own, t) if pairs is None else F.when(_ordered(pairs, t), _shared(own, t)).otherwise(0.0)
    return F.array(*(F.greatest(*(share(t) for t in texts), F.lit(0.0)) for texts in TEMPLATES.values()))


def _held(words: str, pairs: Column | None = None) -> Column:
    """Per family the number of words held of the longest template that confirms the unit."""
    own = F.array_distinct(words)

    def held(t):
        n = len(set(plain_words(t)))
        return F.when((_shared(own, t) >= CONFIRM) & (F.lit(True) if pairs is None else _ordered(pairs, t)), F.round(_shared(own, t) * n).cast("int")).otherwise(0)

    return F.array(*(F.greatest(*(held(t) for t in texts), F.lit(0)) for texts in TEMPLATES.values()))


def _enough(words: str) -> Column:
    return F.array_max(_alike(words)) >= CONFIRM


def _pairs(words: str) -> Column:
    n = F.size(words)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", F.get(F.col(words), i), F.get(F.col(words), i + 1)))).otherwise(F.array().cast("array<string>"))


def notices(confirmed: DataFrame) -> DataFrame:
    """(doc, line, last, family) of the confirmed units that are reported: of those of a family that overlap by more than one line the one that holds most words, then the shortest."""
    unit = F.struct("line", "last", "held")
    spans = confirmed.groupBy("doc", "family").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    kind = "struct<line:int,last:int,held:int>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("end"))

    def add(acc, x):
        end = acc["end"]
        apart = end.isNull() | (x["line"] > end["last"]) | ((x["line"] == end["last"]) & (x["line"] > end["line"]) & (x["last"] > x["line"]))
        better = (x["held"] > end["held"]) | ((x["held"] == end["held"]) & (x["last"] - x["line"] < end["last"] - end["line"]))
        return F.struct(F.when(apart & end.isNotNull(), F.concat(acc["done"], F.array(end))).otherwise(acc["done"]).alias("done"), F.when(apart | better, x).otherwise(end).alias("end"))

    folded = spans.select("doc", "family", F.aggregate("units", start, add, lambda a: F.concat(a["done"], F.array(a["end"]))).alias("units"))
    return folded.select("doc", "family", F.explode("units").alias("u")).select("doc", "u.line", "u.last", "family")


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per line with an anchor and per confirmed notice: doc_id, paragraph (its first line), family (or unknown), probability, similarity, confirmed."""
    spark = docs.sparkSession
    weights, bias, temperature = fit(spark, docs, text_col=text_col)
    classes = [*TEMPLATES, NONE]
    model = _weights(spark, weights, len(classes))
    rows = written(lines(docs, id_col=id_col, text_col=text_col), "licence-lines")
    single = rows.filter("candidate").select("doc", "doc_id", "line", F.col("line").alias("last"), "anchored", "words", _alike("words").alias("alike"), _held("words").alias("held")).filter(
        F.col("anchored") | (F.array_max("alike") >= CONFIRM))
    wrapped = runs(rows).withColumn("pairs", _pairs("words")).select("doc", "doc_id", "line", "last", F.lit(False).alias("anchored"), "words", _alike("words", F.col("pairs")).alias("alike"), _held("words", F.col("pairs")).alias("held"))
    units = written(single.union(wrapped.filter(F.array_max("alike") >= CONFIRM)).withColumn("row", F.monotonically_increasing_id()), "licence-units")
    found = units.drop("words").join(class_sums(units, model, len(classes)), "row", "left")
    z = [(F.lit(bias[name]) + F.coalesce(f"z{c}", F.lit(0.0)) / F.sqrt(F.greatest("n", F.lit(1)))) / temperature for c, name in enumerate(classes)]
    top = F.greatest(*z)
    e = [F.exp(v - top) for v in z]
    total = sum(e[1:], e[0])
    best = F.greatest(*(F.struct((v / total).alias("p"), F.lit(name).alias("family")) for v, name in zip(e, classes)))
    scored = written(found.select("doc", "doc_id", "line", "last", "anchored", "alike", "held", best.alias("best")), "licence-scores")
    known = (F.col("best.family") != NONE) & (F.col("best.p") >= KNOWN)
    own = lambda name, zero: F.coalesce(*(F.when(F.col("best.family") == family, F.col(name)[c]) for c, family in enumerate(TEMPLATES)), F.lit(zero))
    judged = scored.select("doc", "doc_id", "line", "last", "anchored", F.when(known, F.col("best.family")).otherwise(UNKNOWN).alias("family"), F.col("best.p").alias("probability"),
                           F.when(known, own("alike", 0.0)).otherwise(0.0).alias("similarity"), own("held", 0).alias("held"))
    judged = judged.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("similarity") >= CONFIRM)).filter("anchored or confirmed")
    kept = notices(judged.filter("confirmed"))
    inside = kept.filter("last > line").select("doc", F.explode(F.sequence("line", "last")).alias("line")).distinct()
    plain = judged.filter("not confirmed").join(inside, ["doc", "line"], "left_anti")
    out = judged.filter("confirmed").join(kept, ["doc", "line", "last", "family"], "left_semi")
    columns = ["doc_id", F.col("line").cast("long").alias("paragraph"), "family", "probability", "similarity", "confirmed"]
    return out.select(*columns).union(plain.select(*columns))
