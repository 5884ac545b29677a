"""What several operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import kept
from ..session import configure

# A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Whole texts pass through Python workers in batches bounded in bytes, and the
# shuffle files of a finished query are removed: the operators run several
# written steps, each of which needs only the tables of the step before.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings, and let Python workers import the library from where the driver has it."""
    configure(spark)
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """Together with the id this names a row; repeated rows share it."""
    return F.xxhash64(whole_text(name))


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of the named columns, null being equal to null."""
    condition = F.lit(True)
    for name in names:
        condition &= left[name].eqNullSafe(right[name])
    return condition


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with a line after them as often as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def sums_before(
    df: DataFrame, order: list[str], values: list[str], label: str, keep: Callable[[DataFrame, str], DataFrame] = kept
) -> DataFrame:
    """``df`` with ``before_<value>``: the sum of a value over all rows that sort earlier.

    The rows are range-partitioned by ``order`` and written; each partition then
    needs only the totals of the partitions before it, one row per partition.
    ``order`` has to be unique up to rows that are alike in all columns.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    cut = keep(ranged, label)
    earlier_parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    offsets = offsets.select(
        F.col("_part").alias("_offset_part"),
        *[F.coalesce(F.sum(f"_sum_{v}").over(earlier_parts), F.lit(0)).alias(f"_offset_{v}") for v in values],
    )
    earlier_rows = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({f"_local_{v}": F.coalesce(F.sum(v).over(earlier_rows), F.lit(0)) for v in values})
    joined = local.join(offsets, F.col("_part") == F.col("_offset_part"))
    return joined.select(
        *df.columns, *[(F.col(f"_local_{v}") + F.col(f"_offset_{v}")).alias(f"before_{v}") for v in values]
    )
