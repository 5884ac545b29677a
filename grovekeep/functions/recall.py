"""Spaced-repetition arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .scalars import choose

STATE_FIELDS = ("stability", "difficulty", "review_count", "review_state", "last_review_at")


def elapsed_days(since: Column, as_of: Column) -> Column:
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.greatest(micros / F.lit(1e6 * V.SECONDS_PER_DAY), F.lit(0.0))


def retrievability(stability: Column, last_review_at: Column, as_of: Column) -> Column:
    """exp(-days / stability); 0 when unseen or without stability."""
    seen = (stability > 0) & last_review_at.isNotNull()
    return F.when(seen, F.exp(-elapsed_days(last_review_at, as_of) / stability)).otherwise(F.lit(0.0))


def next_review_at(last_review_at: Column, stability: Column) -> Column:
    """Due time in whole seconds, at most the end of the year 9999."""
    seconds = F.unix_seconds(last_review_at.cast("timestamp"))
    at = seconds + stability * V.INTERVAL_FACTOR * V.SECONDS_PER_DAY
    return F.timestamp_seconds(F.floor(F.least(at, F.lit(V.LAST_SECOND))))


def answer_to_rating(is_correct: Column) -> Column:
    return F.when(is_correct, F.lit(V.RATING_CORRECT)).otherwise(F.lit(V.RATING_WRONG))


def due(stability: Column, last_review_at: Column, next_at: Column, as_of: Column) -> Column:
    return (stability <= 0) | last_review_at.isNull() | (next_at <= as_of)


def _per_rating(rating: Column, table: dict[int, float]) -> Column:
    codes = sorted(table)
    return choose([(rating == c, F.lit(table[c])) for c in codes[:-1]], F.lit(table[codes[-1]]))


def gap_factor(rating: Column) -> Column:
    return F.lit(1.0) - F.lit(V.DIFFICULTY_RATE) * (F.lit(3) - rating)


def step_gap(gap: Column, rating: Column) -> Column:
    """The gap, 1 - difficulty, after one review.

    Folds carry the gap rather than the difficulty: a review multiplies it and caps
    it, so any number of reviews in a row compose without cancellation.
    """
    return F.least(F.lit(1.0 - V.DIFFICULTY_FLOOR), gap_factor(rating) * gap)


def step_stability(stability: Column, count: Column, rating: Column) -> Column:
    first = (count == 0) | (stability <= 0)
    grown = stability * _per_rating(rating, V.STABILITY_FACTOR)
    grown = F.when(rating == 1, F.greatest(F.lit(V.LAPSE_STABILITY_FLOOR), grown)).otherwise(grown)
    return F.when(first, _per_rating(rating, V.FIRST_STABILITY)).otherwise(grown)


def step_state(state: Column, rating: Column) -> Column:
    return (
        F.when(state == "new", F.lit("review"))
        .when(rating == 1, F.lit("relearning"))
        .when((state == "relearning") & (rating >= 3), F.lit("review"))
        .otherwise(state)
    )


def fresh_state() -> Column:
    """State of a node nobody has reviewed."""
    return F.struct(
        F.lit(0.0).alias("stability"),
        F.lit(V.START_DIFFICULTY).alias("difficulty"),
        F.lit(0).cast("bigint").alias("review_count"),
        F.lit("new").alias("review_state"),
        F.lit(None).cast("timestamp").alias("last_review_at"),
        F.lit(1.0 - V.START_DIFFICULTY).alias("gap"),
    )


def clean_state(
    stability: Column, difficulty: Column, count: Column, state: Column, last: Column, gap: Column | None = None
) -> Column:
    """A stored state with zero and missing fields replaced by their defaults; ``gap`` only where a fold has kept it."""
    known = F.when(F.coalesce(difficulty, F.lit(0.0)) == 0, F.lit(V.START_DIFFICULTY)).otherwise(difficulty.cast("double"))
    derived = F.lit(1.0) - known
    return F.struct(
        F.coalesce(stability.cast("double"), F.lit(0.0)).alias("stability"),
        known.alias("difficulty"),
        F.coalesce(count.cast("bigint"), F.lit(0).cast("bigint")).alias("review_count"),
        F.when(F.coalesce(state, F.lit("")) == "", F.lit("new")).otherwise(state).alias("review_state"),
        last.cast("timestamp").alias("last_review_at"),
        (derived if gap is None else F.coalesce(gap, derived)).alias("gap"),
    )


def fsrs_step(state: Column, rating: Column, at: Column) -> Column:
    """State after one review; ``state`` is a struct of STATE_FIELDS and the gap."""
    gap = step_gap(state["gap"], rating)
    return F.struct(
        step_stability(state["stability"], state["review_count"], rating).alias("stability"),
        (F.lit(1.0) - gap).alias("difficulty"),
        (state["review_count"] + F.lit(1)).cast("bigint").alias("review_count"),
        step_state(state["review_state"], rating).alias("review_state"),
        F.date_trunc("second", at).alias("last_review_at"),
        gap.alias("gap"),
    )


def format_stability(stability: Column) -> Column:
    """Readable band: unseen, hours, days or months."""

    def whole(x: Column) -> Column:
        return F.floor(x + 0.5).cast("bigint").cast("string")

    return (
        F.when(stability <= 0, F.lit(V.STABILITY_UNSEEN))
        .when(stability < 1, F.concat(whole(stability * 24), F.lit(V.STABILITY_HOURS)))
        .when(stability < 30, F.concat(whole(stability), F.lit(V.STABILITY_DAYS)))
        .otherwise(F.concat(whole(stability / 30), F.lit(V.STABILITY_MONTHS)))
    )


def growth_multiplier(avg_stability: Column, coverage: Column) -> Column:
    """Maturity scalar of a forest from its rounded stability and coverage."""
    norm = F.when(
        avg_stability > 0, F.least(F.lit(1.0), F.log1p(avg_stability) / F.log(F.lit(31.0)))
    ).otherwise(F.lit(0.0))
    return F.lit(0.3) + F.lit(2.2) * (F.lit(0.3) * coverage + F.lit(0.7) * norm)


def growth_stage(coverage: Column, avg_stability: Column) -> Column:
    bands = [(coverage == 0, F.lit(V.GROWTH_STAGE_NONE))]
    bands += [((coverage < c) | (avg_stability < s), F.lit(label)) for c, s, label in V.GROWTH_STAGES]
    return choose(bands, F.lit(V.GROWTH_STAGE_FULL))


def size_tier(node_count: Column) -> Column:
    bands = [(node_count < b, F.lit(i)) for i, b in enumerate(V.SIZE_TIER_BOUNDS)]
    return choose(bands, F.lit(len(V.SIZE_TIER_BOUNDS)))
