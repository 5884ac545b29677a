"""Statistics of whole forests: per root and per owner."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.recall import growth_multiplier
from ..functions.scalars import falsy_default, round_half_even
from .keyed import HOT_ROWS, running_sums

FULL_TURN = 2 * math.pi


def forest_roots(shape: DataFrame) -> DataFrame:
    """Root rows of ``subtree_shape(nodes, carry=("parent_id", ...))``.

    Roots are nodes without a stored parent; an owner with none of those falls
    back to the nodes at depth 0.
    """
    tops = shape.where(F.col("depth") == 0)
    proper = tops.where(F.col("parent_id").isNull())
    without = tops.join(proper.select("owner_id").distinct(), "owner_id", "left_anti")
    return proper.unionByName(without)


def root_stats(shape: DataFrame, states: DataFrame) -> DataFrame:
    """Per root: descendants, height, size and its recall fields."""
    recall = states.select(
        "id",
        "name",
        falsy_default(F.col("stability"), 0.0, T.DoubleType()).alias("stability"),
        falsy_default(F.col("difficulty"), V.START_DIFFICULTY, T.DoubleType()).alias("difficulty"),
        falsy_default(F.col("review_count"), 0, T.LongType()).alias("review_count"),
        falsy_default(F.col("review_state"), "new", T.StringType()).alias("review_state"),
        falsy_default(F.col("mastery"), 0.0, T.DoubleType()).alias("mastery_score"),
    )
    roots = forest_roots(shape).select(
        "owner_id", "id", (F.col("subtree_size") - 1).alias("descendants"), "height", "subtree_size"
    )
    return roots.join(recall, "id")


def _owner_totals(shape: DataFrame) -> DataFrame:
    return shape.groupBy("owner_id").agg(F.count(F.lit(1)).alias("total_nodes"))


def forest_health(roots: DataFrame, shape: DataFrame) -> DataFrame:
    """Per owner: averages over the roots, coverage, size and growth multiplier."""
    reviewed = F.count_if(F.col("review_count") > 0)
    per_owner = roots.groupBy("owner_id").agg(
        round_half_even(F.avg("stability"), 2).alias("avg_stability"),
        round_half_even(F.avg("mastery_score"), 4).alias("avg_mastery"),
        round_half_even(reviewed / F.count(F.lit(1)), 4).alias("review_coverage"),
        reviewed.alias("reviewed_nodes"),
    )
    growth = round_half_even(growth_multiplier(F.col("avg_stability"), F.col("review_coverage")), 4)
    return per_owner.join(_owner_totals(shape), "owner_id").withColumn("growth_multiplier", growth)


def shape_ratios(roots: DataFrame, shape: DataFrame) -> DataFrame:
    """Roots against height, within 0.1 and 10, and the largest tree's share."""
    per_owner = roots.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("n_roots"), F.max("height").alias("max_depth"), F.max("subtree_size").alias("_largest")
    )
    ratio = F.col("n_roots") / F.greatest(F.col("max_depth"), F.lit(1))
    return (
        per_owner.join(_owner_totals(shape), "owner_id")
        .withColumn("width_depth_ratio", F.greatest(F.lit(0.1), F.least(F.lit(10.0), ratio)))
        .withColumn("max_subtree_ratio", F.col("_largest") / F.col("total_nodes"))
        .drop("_largest")
    )


def node_depth_ratio(shape: DataFrame) -> DataFrame:
    """Nodes against greatest depth, 1 for a flat forest: the client's variant."""
    per_owner = shape.groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d"))
    ratio = F.when(F.col("d") > 0, F.col("n") / F.col("d")).otherwise(F.lit(1.0))
    return per_owner.select("owner_id", ratio.alias("node_depth_ratio"))


def proportional_ranges(
    roots: DataFrame, health: DataFrame, order: list[Column] | None = None, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Contiguous spans of a full turn, one per root, in proportion to its size.

    ``quota`` is the root's part of the owner's point budget, at least 3.
    """
    order = [F.col("id")] if order is None else order
    weight = F.col("subtree_size").cast("double")
    totals = roots.groupBy("owner_id").agg(F.sum("subtree_size").cast("double").alias("_sum"))
    budget = health.select(
        "owner_id", F.least(F.lit(500), F.floor((50 + 3 * F.col("total_nodes")) * F.col("growth_multiplier"))).alias("_budget")
    )
    running = running_sums(roots, ["owner_id"], order, {"_upto": F.col("subtree_size")}, hot_rows=hot_rows)
    end = F.lit(-math.pi) + FULL_TURN * F.col("_upto") / F.col("_sum")
    start = F.lit(-math.pi) + FULL_TURN * (F.col("_upto") - F.col("subtree_size")) / F.col("_sum")
    quota = F.greatest(F.lit(3).cast("bigint"), F.floor(F.col("_budget") * weight / F.col("_sum")))
    return (
        running.join(totals, "owner_id")
        .join(budget, "owner_id")
        .select("owner_id", "id", "subtree_size", start.alias("angle_start"), end.alias("angle_end"), quota.alias("quota"))
    )
