"""Corpus pipeline: toxicity, quality rules, near duplicates, benchmark decontamination, packing.

Every stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's documents. All stages but the last return the
columns of their documents; the last returns the pieces of the packed sequences.

A document is known by its id and a hash of its text, so repeated ids with other texts are documents of their
own. Each operator names the keys that go (or stay) and one join on the key applies that; columns of any
other name pass through unchanged. Null
and empty texts pass the toxicity stage, fail the quality rules (no words) and so never reach the later stages;
empty tables pass through all stages; rows that repeat id and text are one document, of which one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackwise.llm.decontaminate import contamination
from stackwise.llm.jaccard import jaccard_components
from stackwise.llm.packing import pack
from stackwise.llm.rules import quality_rules
from stackwise.llm.toxicity import toxicity_scores
from stackwise.session import release, scratch_path, scratch_run

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with their key, under a name that none of their columns has."""
    taken, name = {c.lower() for c in docs.columns}, "_document_key"
    while name in taken:
        name += "_"
    return docs.withColumn(name, F.struct("doc_id", F.xxhash64("text").alias("mark"))), name


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return _keyed(docs)[0].join(gone.select(key).distinct(), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    keyed, key = _keyed(docs)
    scored = toxicity_scores(keyed, _table(spark, sf_dir, "labels"), carry=(key,))
    return _without(docs, scored.filter("predicted = 1"), key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    keyed, key = _keyed(docs)
    judged = quality_rules(keyed, id_col=key)
    return _without(docs, judged.filter(~F.col("kept")).select(F.col("doc_id").alias(key)), key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles with a similarity of 0.8 or more, the document of the smallest id stays."""
    keyed, key = _keyed(docs)
    grouped = jaccard_components(keyed, id_col=key, words=5, percent=80)
    stay = grouped.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key))
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    keyed, key = _keyed(docs)
    report = contamination(keyed, _table(spark, sf_dir, "benchmark"), id_col=key)
    return _without(docs, report.filter("contaminated").select(F.col("doc_id").alias(key)), key)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    pieces = pack(docs, TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Model scores, links and token ids are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder and read again.

    What a stage writes for itself, and the result that the stage before wrote, are deleted once its own result is written.
    """
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_run(spark):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before is not None:
            release(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
