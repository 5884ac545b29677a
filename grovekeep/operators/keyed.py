"""Per-group orderings that stay distributed when one group is huge.

A plain window sends a whole group to one task.  The operators here measure
group sizes first (a map-side combined count over the key columns only) and
give groups above ``hot_rows`` a route of their own: rows are range-partitioned
by group and order, so that one group spans many partitions, and each slice
then only needs the totals of the slices before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import kept

HOT_ROWS = 1_000_000
# A slice is a task: however few rows make a group hot, slices hold about so many, so that the tasks of a cut, each of
# which reports to the driver, and the sample behind it stay few.
SLICE_ROWS = 100_000


def null_safe_join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on ``names``, a null key matching null; the key columns come from the left."""
    renamed = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    match = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_right_{n}")) for n in names])
    return left.join(renamed, match, how).drop(*[f"_right_{n}" for n in names])


def hot_groups(df: DataFrame, by: list[str], hot_rows: int) -> tuple[DataFrame | None, int]:
    """Groups above ``hot_rows`` and the rows they hold, or ``(None, 0)``.

    There are at most ``rows / hot_rows`` such groups.
    """
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    total = counted.agg(F.sum("_n")).first()[0]
    return (None, 0) if total is None else (counted.drop("_n"), total)


def split_hot(df: DataFrame, by: list[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside the hot groups."""
    return null_safe_join(df, hot, by, "left_anti"), null_safe_join(df, hot, by, "left_semi")


def sliced(df: DataFrame, by: list[str], order: list[Column], rows: int, per_slice: int) -> DataFrame:
    """``df`` with ``_slice``: consecutive ranges of (group, order).

    The slices are written out, so every later reader sees the same cut.
    """
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(shuffles, -(-rows // max(per_slice, SLICE_ROWS)))
    ranged = df.repartitionByRange(n, *by, *order)
    return kept(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def running_sums(
    df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column], *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``df`` with, per name, the running total of a value within each group.

    Totals include the row's own value and follow ``order``, which must be
    unique within a group.  Null group keys form groups of their own.
    """

    def through_window(part: DataFrame, keys: list[str]) -> DataFrame:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return part.withColumns({name: F.sum(value).over(frame) for name, value in values.items()})

    hot, rows = hot_groups(df, by, hot_rows)
    if hot is None:
        return through_window(df, by)

    cold_part, hot_part = split_hot(df, by, hot)
    cuts = sliced(hot_part, by, order, rows, hot_rows)
    keys = [*by, "_slice"]
    # One row per group and slice: a hot group has as many as it has slices.
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cuts.groupBy(*keys).agg(*[F.sum(value).alias(name) for name, value in values.items()])
    offsets = offsets.select(
        *keys, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in values]
    )
    joined = null_safe_join(through_window(cuts, keys), offsets, keys)
    done = joined.select(*df.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in values])
    return through_window(cold_part, by).unionByName(done)


def rank_rows(df: DataFrame, by: list[str], order: list[Column], out: str, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based position within the group; ``order`` must be unique there."""
    return running_sums(df, by, order, {out: F.lit(1).cast("bigint")}, hot_rows=hot_rows)


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group; ``order`` must be unique there.

    Up to a threshold of its own Spark limits each group before the shuffle, so a
    hot group ships at most ``n`` rows per input partition.  Beyond it rows are
    ranked by :func:`rank_rows`, which spreads hot groups, with the same result.
    """
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        return rank_rows(df, by, order, out).where(F.col(out) <= n).withColumn(out, F.col(out).cast("int"))
    frame = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(frame)).where(F.col(out) <= n)


def _extreme_rows(df: DataFrame, by: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in by and c not in order]
    row = F.struct(*order, *rest)
    grouped = df.groupBy(*by).agg(pick(row).alias("_row"))
    return grouped.select(*[F.col(c) if c in by else F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Row of each group that comes first by the ``order`` columns.

    The minimum of one struct, order columns in front: combined before the
    shuffle, so a hot group ships one row per input partition.
    """
    return _extreme_rows(df, by, order, F.min)


def last_rows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Row of each group that comes last by the ``order`` columns; see :func:`first_rows`."""
    return _extreme_rows(df, by, order, F.max)
