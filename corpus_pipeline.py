"""From raw documents to shards of training text: five stages, each written and read again.

Quality classifier, near-duplicate removal, benchmark decontamination, mixing of
sources to target weights, sharding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekeep.llm import decontaminate, mixing, near_dups, quality, reshard
from grovekeep.llm.common import read, tune
from grovekeep.llm.queries import SHARDS, fold, old_shard
from grovekeep.scratch import kept


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality; the model learns from labels outside the held-out third."""
    tune(spark)
    labels = read(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit_quality(docs, labels)
    return docs.where(quality.quality_score(model, docs) >= 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8 or more), the one with the smallest id."""
    tune(spark)
    return near_dups.keep_one(docs, near_dups.near_groups(docs, shingle=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mixture: repeated or left out as the sources' targets ask, the row at a cut shortened."""
    tune(spark)
    return mixing.take_mixture(docs, mixing.mix_sources(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard of sixteen of near equal bytes, and its slot there."""
    tune(spark)
    placed = reshard.reshard_files(docs, old_shard(), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")


STAGES = [
    ("quality", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontaminate", decontamination),
    ("mix", mixture),
    ("shard", sharding),
]

# A fitted model cannot be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
