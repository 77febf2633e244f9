"""Stages of the corpus pipeline: (name, function of spark, docs, sf_dir). Each works on all that the one before kept.

All stages but the last return the columns of `documents`. Nulls are kept where a stage has no reason to drop a row: a
null text is neither toxic, near another, contaminated nor personal, becomes the empty text in the PII stage, and packs
as its closing id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, packing, pii, toxicity
from .common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more go."""
    docs = docs.select(*COLUMNS)
    return toxicity.reject(docs, toxicity.taught(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by a five-word Jaccard similarity of 0.8 or more, the one with the least doc_id stays."""
    own = ("doc_id", "tag")
    docs = docs.select(*COLUMNS, F.xxhash64("text").alias("tag"))
    rows = stored(jaccard_join.join(docs), "groups").where("able")
    first = (F.col("doc_id") == F.col("group_id")) & (F.col("tag") == F.col("group_tag"))
    held = lambda df: F.broadcast(df) if df.count() <= jaccard_join.BROADCAST_ROWS else df
    out = docs.join(held(stored(rows.where(~first).select(*own).distinct(), "others")), list(own), "left_anti")
    again = stored(rows.where(first).groupBy(*own).count().where("count > 1").select(*own), "again")
    if not again.isEmpty():  # rows that repeat an id and a text are one group as well
        out = out.join(held(again), list(own), "left_anti").unionByName(out.join(held(again), list(own), "left_semi").dropDuplicates(list(own)))
    return out.select(*COLUMNS)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), others=("lang", "source", "n_chars"))
    return out.where(F.size("hit_words") == 0).select(*COLUMNS)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts."""
    out = pii.sanitise(docs, others=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", contaminated), ("pii", personal), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
