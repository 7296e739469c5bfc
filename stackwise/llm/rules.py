"""Operator 6: quality rules by distribution divergence, in DataFrame functions only.

Each text gives base counts (words, symbols, repeated lines and windows) and two histograms: character
classes, and common words of the known languages. The histograms of all texts of a language, each text
weighted alike, are its reference. A text whose Jensen-Shannon distance to its language's reference is
large in either histogram fails; texts too short for a stable histogram are not judged by it.

The counts are written once, so texts are read once; references are a few rows per language and are joined
by broadcast. Windows are compared by 64-bit hashes inside their text.

Defined cases: null and empty texts have no words (and fail for having too few); a null or unknown language is
measured against the reference of all texts; a text of any length is one row, in time that grows as
n log n; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackwise.llm.shared import written

#: Common words by language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as"],
    "de": ["der", "die", "und", "den", "das", "ist", "von", "zu", "mit", "sich", "nicht", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "pour"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
#: Character classes as regular expressions; the last class is all the rest (lower case, blanks, other letters).
CLASSES = {"upper": "A-Z", "digit": "0-9", "symbol": r"#*$%&|<>", "mark": r"!.,;:?"}
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8

MIN_WORDS = 20          # fewer words fail
MAX_REPEAT = 30         # per cent of words in repeated windows
MIN_CHARS = 200         # word characters from which character classes are judged
MIN_COMMON_WORDS = 60   # words from which common words are judged
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45
OTHER = "*"             # the reference of all texts

_VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})


def _class_length(text: Column, inside: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{inside}]+", "")).cast("long")


def _with_repeats(rows: DataFrame, words: str) -> DataFrame:
    """Adds ``n_repeat_words``: words inside windows that occur twice or more in the array column ``words``, which goes.

    Hashes of one word are zipped with themselves, shifted, into hashes of 2, 4 and 8 words. A row without a repeated
    window ends after one distinct; else its (hash, position) pairs are sorted and equal neighbours are
    the repeats. Every array is a column of its own, so it is made once per row.
    """
    n = F.col("n_words").cast("int")
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("_g1", F.transform(words, lambda w: F.xxhash64(w))).drop(words)
    for half in (1, 2, 4):
        joined = F.zip_with(f"_g{half}", F.slice(f"_g{half}", half + 1, n), lambda a, b: F.xxhash64(a, b))
        rows = rows.withColumn(f"_g{2 * half}", joined).drop(f"_g{half}")
    rows = rows.withColumn("_windows", F.when(n > WINDOW, F.slice("_g8", 1, n - WINDOW + 1)).otherwise(none)).drop("_g8")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.withColumn("_pairs", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_windows")
    twice = F.transform("_pairs", lambda p, i: F.when((p["h"] == F.get(F.col("_pairs"), i - 1)["h"]) | (p["h"] == F.get(F.col("_pairs"), i + 1)["h"]), p["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(F.sort_array(F.filter(twice, lambda i: i.isNotNull())), start,
                          lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["end"], i.cast("long"))).alias("n"), (i + WINDOW).cast("long").alias("end")))["n"]
    return rows.withColumn("n_repeat_words", covered).drop("_pairs")


def document_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang (one of the known or OTHER), base counts, and the histograms ``chars`` and ``common``.

    A common word counts where it stands bare between blanks, in lower case or capitalised.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.col(lang_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(lang.isin(*COMMON_WORDS), lang).otherwise(OTHER).alias("lang"), text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "lang", F.length("_text").cast("long").alias("_length"), lines.alias("_lines"), F.regexp_replace("_text", "[a-z ]+", "").alias("_marks"),
                       F.array_remove(F.split("_text", SPACE), "").alias("_words"))
    known = F.filter("_words", lambda w: w.isin(*_VOCABULARY, *(w.capitalize() for w in _VOCABULARY)))
    rows = rows.select("doc_id", "lang", "_length", F.array(*(_class_length(F.col("_marks"), inside) for inside in CLASSES.values())).alias("_chars"), "_words", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                       F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                       F.lower(F.concat(F.lit(" "), F.array_join(known, "  "), F.lit(" "))).alias("_known"))
    counted = _with_repeats(rows, "_words")
    common = [((F.length("_known") - F.length(F.replace("_known", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in _VOCABULARY]
    counted = counted.select("doc_id", "lang", "n_words", "word_chars", F.col("_chars")[list(CLASSES).index("symbol")].alias("n_symbols"), "n_dup_lines", "n_repeat_words",
                             "_length", "_chars", F.array(*common).alias("_common"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return counted.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          F.concat("_chars", F.array(F.col("_length") - total("_chars"))).alias("chars"),
                          F.concat("_common", F.array(F.greatest(F.col("n_words") - total("_common"), F.lit(0)))).alias("common"))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two share arrays of the same length."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: 0.5 * (half(a, (a + b) / 2) + half(b, (a + b) / 2)))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0)))


def references(counts: DataFrame) -> DataFrame:
    """Mean histograms per language, and of all texts under OTHER: at most one row for each known language and one more."""
    long_enough = counts.filter((F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("word_chars") >= MIN_CHARS))
    sizes = {"chars": len(CLASSES) + 1, "common": len(_VOCABULARY) + 1}
    each = long_enough.select("lang", shares(F.col("chars")).alias("chars"), shares(F.col("common")).alias("common"))
    sums = each.groupBy("lang").agg(F.count("*").alias("n"), *(F.sum(F.col(c)[i]).alias(f"{c}{i}") for c, k in sizes.items() for i in range(k)))
    both = sums.union(sums.groupBy(F.lit(OTHER).alias("lang")).agg(*(F.sum(c).alias(c) for c in sums.columns[1:])))
    one = both.groupBy("lang").agg(*(F.max_by(c, "n").alias(c) for c in both.columns[1:]))  # OTHER: all texts, not only the unknown
    return one.select("lang", *(F.array(*(F.col(f"{c}{i}") / F.col("n") for i in range(k))).alias(f"ref_{c}") for c, k in sizes.items()))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_char_distance: float = MAX_CHAR_DISTANCE,
                  max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Per document the base counts, base_failed, both distances (null where not judged) and kept."""
    counts = written(document_counts(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), "rule-counts")
    ref = references(counts)
    near = counts.join(F.broadcast(ref), "lang", "left")
    judged = near.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         F.when(F.col("word_chars") >= MIN_CHARS, jensen_shannon(shares(F.col("chars")), F.col("ref_chars"))).alias("char_distance"),
                         F.when(F.col("n_words") >= MIN_COMMON_WORDS, jensen_shannon(shares(F.col("common")), F.col("ref_common"))).alias("word_distance"),
                         ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))).alias("base_failed"))
    far = (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return judged.select("*", (~F.col("base_failed") & ~far).alias("kept"))
