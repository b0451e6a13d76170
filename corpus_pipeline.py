"""The corpus pipeline: five operators one after another over the whole ``documents`` table.

Defined results: a null or empty text fails the base rules, so it goes in the first stage; documents with a
null id go the same way as others, and of repeated rows one stays; a null source is a source of its own;
columns besides those of ``documents`` are carried up to packing, whatever their names; an empty table gives
an empty result. Each stage's tables go once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from tagloom.llm.common import scratch, table, written


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` brought up to date where there is a text."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    return quality_rules.keep_good(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return near_dedup.deduplicated(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask."""
    return _counted(secret_scan.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a row for each pass over a document, dealt to shards and shuffled there."""
    return _counted(mixing.mixed_rows(docs, shard_col="_shard").drop("_shard"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 4096 tokens."""
    return packing.digest(packing.pack(docs))


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("secret_scan", secrets), ("mixing", mix), ("packing", pack)]

#: Trees, sketches and tokenizers are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), len(STAGES) - 1
    for at, (_, stage) in enumerate(STAGES):
        if at == last:
            return stage(spark, docs, sf_dir)
        with scratch(spark) as made:
            result = written(stage(spark, docs, sf_dir))
            path = made.pop()
            if at:
                made.append(before)
        docs, before = result, path
