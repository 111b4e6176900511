"""A training corpus from the documents table: quality rules, near
duplicates, benchmark decontamination, mixing to target weights, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's documents.

All stages take any rows: nulls in every column, empty and very long texts,
repeated rows, extra columns (kept by all but the last, whatever their names)
and empty tables (which stay empty)."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparqa.llm import decontamination, mixing, near_dedup, quality_rules, sharding  # noqa: E402
from sparqa.llm.queries import MIX_SEED, MIX_WEIGHTS, SHARD_SEED, SHARDS, shards_digest  # noqa: E402
from sparqa.session import drop_tracked, ensure_checkpoint_dir, tracked, work_dir  # noqa: E402


# intermediate tables of the last stage
_LAST: list = []


def _stage(name: str, work):
    """(name, function) of a stage.  A stage begins when the one before it is
    written, so that one's intermediate tables are dropped first."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_intermediate(spark)
        with tracked() as made:
            _LAST.append(made)
            return work(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = work.__name__, work.__doc__
    return name, run_stage


def drop_intermediate(spark: SparkSession) -> None:
    """Drop the intermediate tables of the last stage."""
    while _LAST:
        drop_tracked(spark, _LAST.pop())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail the plain rules and go; a null lang or source is a
    group of its own; repeated rows are judged alike and all kept or dropped;
    ties in distance are judged by the distance alone."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8).

    The smallest doc_id of a group stays, rows without one come last; a doc_id
    that occurs with several texts is judged by each text, and of fully equal
    rows one stays.  Texts without words (none pass the stage before) are kept."""
    return near_dedup.keep_first(docs, shingle_words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs.

    Texts alone decide, so repeated and null doc_ids do not matter; null texts
    are clean; an empty benchmark leaves all.  Exact windows decide: a proximity
    match (``near_items``) has the words in another order or with others between
    them, which clean texts of common words have too."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.xxhash64("text")
    # contamination depends on the text alone
    found = decontamination.decontaminate(docs.select(key.alias("doc_id"), "text"), benchmark, window=10)
    found = found.where("contaminated").select(F.col("doc_id").alias("__key")).distinct()
    return docs.withColumn("__key", key).join(found, "__key", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order.

    Each row is drawn by its own, repeated rows and rows without a doc_id too; a
    null source counts as ``""``; equal order keys are ordered by doc_id."""
    return mixing.mix(docs, MIX_WEIGHTS, 1.0, MIX_SEED).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot.

    Copies, null doc_ids and null texts are rows like any other; shard sizes
    differ by one row at most."""
    return shards_digest(sharding.shard(docs.select("doc_id", "text"), SHARDS, SHARD_SEED))


STAGES = [
    _stage("quality rules", quality),
    _stage("near duplicates", near_duplicates),
    _stage("benchmark decontamination", decontaminate),
    _stage("mixing to target weights", mix),
    _stage("sharding", shards),
]

#: connected components, robust estimates and shuffles are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(spark)
    drop_intermediate(spark)
    for k, (_, stage) in enumerate(STAGES):
        path = work_dir(spark, f"stage{k}")  # made before the stage's scope opens, so it stays
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        drop_intermediate(spark)
    return docs
