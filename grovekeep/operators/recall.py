"""Review logs, recall state folded from them, and statistics over that state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import recall as R
from ..functions.scalars import round_half_even, round_half_up
from ..scratch import kept
from .keyed import hot_groups, rank_rows, split_hot, top_rows

KEY = ["owner_id", "node_id"]
# Longest log folded as one array, per key; longer logs are folded in blocks.
FOLD_EVENTS = 100_000
HISTORY_EVENTS = 2_000
BLOCK = 1_000


def review_log(reviews: DataFrame, answers: DataFrame) -> DataFrame:
    """Ratings and graded answers as one event table."""
    columns = ["event_id", "owner_id", "node_id", "rating", "reviewed_at"]
    graded = answers.withColumn("rating", R.answer_to_rating(F.col("is_correct"))).select(*columns)
    return reviews.select(*columns).unionByName(graded)


def valid_rating(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows rated 1..4, and the others."""
    ok = F.coalesce(F.col("rating").isin(1, 2, 3, 4), F.lit(False))
    return reviews.where(ok), reviews.where(~ok)


def owned_events(reviews: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events whose node is live and belongs to the sender, and the others."""
    live = nodes.where(~F.col("is_deleted")).select("owner_id", F.col("id").alias("node_id"))
    return reviews.join(live, KEY, "left_semi"), reviews.join(live, KEY, "left_anti")


# --- folding ------------------------------------------------------------------


def _event_list() -> Column:
    return F.sort_array(F.collect_list(F.struct("reviewed_at", "event_id", "rating"))).alias("log")


def _start(log: DataFrame, initial: DataFrame | None, keys: list[str] = KEY) -> DataFrame:
    """``log`` with ``start``: the state its key had before the first event."""
    if initial is None:
        return log.withColumn("start", R.fresh_state())
    gap = F.col("gap") if "gap" in initial.columns else None
    stored = initial.select(*keys, R.clean_state(*[F.col(c) for c in R.STATE_FIELDS], gap).alias("start"))
    return log.join(stored, keys, "left").withColumn("start", F.coalesce("start", R.fresh_state()))


def _step(state: Column, event: Column) -> Column:
    return R.fsrs_step(state, event["rating"], event["reviewed_at"])


def _block_start() -> Column:
    """A block of reviews that changes nothing.

    After a key's first review every later step is one of three kinds of map,
    and each kind is closed under composition: stability goes to
    max(floor, factor * s), the gap below difficulty 1 to min(cap, slope * gap),
    and the state is settled by the last rating other than 2.
    """
    return F.struct(
        F.lit(0.0).alias("floor"),
        F.lit(1.0).alias("factor"),
        F.lit(1.0).alias("slope"),
        F.lit(float("inf")).alias("cap"),
        F.lit(0).cast("bigint").alias("count"),
        F.lit(None).cast("string").alias("settled"),
        F.lit(None).cast("timestamp").alias("last"),
    )


def _scaled(factor: Column, s: Column) -> Column:
    """Product in which an infinite stability stays infinite, and zero stays zero."""
    return F.when((s == float("inf")) | (s == 0), s).otherwise(factor * s)


def _then(a: Column, b: Column) -> Column:
    """Block ``a`` followed by block ``b``."""
    return F.struct(
        F.greatest(b["floor"], _scaled(b["factor"], a["floor"])).alias("floor"),
        _scaled(b["factor"], a["factor"]).alias("factor"),
        _scaled(b["slope"], a["slope"]).alias("slope"),
        F.least(b["cap"], _scaled(b["slope"], a["cap"])).alias("cap"),
        (a["count"] + b["count"]).cast("bigint").alias("count"),
        F.coalesce(b["settled"], a["settled"]).alias("settled"),
        F.coalesce(b["last"], a["last"]).alias("last"),
    )


def _of_event(event: Column) -> Column:
    rating = event["rating"]
    factor = reduce(lambda acc, c: F.when(rating == c, F.lit(V.STABILITY_FACTOR[c])).otherwise(acc), (1, 2, 3), F.lit(V.STABILITY_FACTOR[4]))
    return F.struct(
        F.when(rating == 1, F.lit(V.LAPSE_STABILITY_FLOOR)).otherwise(F.lit(0.0)).alias("floor"),
        factor.alias("factor"),
        R.gap_factor(rating).alias("slope"),
        F.lit(1.0 - V.DIFFICULTY_FLOOR).alias("cap"),
        F.lit(1).cast("bigint").alias("count"),
        F.when(rating == 1, F.lit("relearning")).when(rating >= 3, F.lit("review")).alias("settled"),
        F.date_trunc("second", event["reviewed_at"]).alias("last"),
    )


def _apply(block: Column, state: Column) -> Column:
    gap = F.least(block["cap"], _scaled(block["slope"], state["gap"]))
    return F.struct(
        F.greatest(block["floor"], _scaled(block["factor"], state["stability"])).alias("stability"),
        (F.lit(1.0) - gap).alias("difficulty"),
        (state["review_count"] + block["count"]).cast("bigint").alias("review_count"),
        F.coalesce(block["settled"], state["review_state"]).alias("review_state"),
        F.coalesce(block["last"], state["last_review_at"]).alias("last_review_at"),
        gap.alias("gap"),
    )


def _joined(blocks: Column) -> Column:
    """Composition of an ordered array of structs with a ``block`` field."""
    return F.aggregate(blocks, _block_start(), lambda a, b: _then(a, b["block"]))


def _long_logs(log: DataFrame, initial: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Logs too long for one task: openings, events by block, blocks, super-blocks."""
    ranked = rank_rows(log, KEY, [F.col("reviewed_at"), F.col("event_id")], "_rank")
    ranked = kept(
        ranked.withColumn("_block", F.floor(F.col("_rank") / BLOCK)).withColumn("_group", F.floor(F.col("_rank") / BLOCK**2)),
        "ranked-log",
    )
    first = _start(ranked.where(F.col("_rank") == 1), initial)
    opening = first.select(*KEY, "event_id", "reviewed_at", "rating", R.fsrs_step(F.col("start"), F.col("rating"), F.col("reviewed_at")).alias("state"))
    rest = ranked.where(F.col("_rank") > 1).groupBy(*KEY, "_group", "_block").agg(_event_list())
    merged = F.aggregate("log", _block_start(), lambda a, e: _then(a, _of_event(e)))
    blocks = rest.select(*KEY, "_group", "_block", merged.alias("block"))
    groups = (
        blocks.groupBy(*KEY, "_group")
        .agg(F.sort_array(F.collect_list(F.struct("_block", "block"))).alias("blocks"))
        .select(*KEY, "_group", _joined(F.col("blocks")).alias("block"))
    )
    return opening, rest, blocks, groups


def _columns_of(state: str) -> list[Column]:
    return [F.col(f"{state}.{c}").alias(c) for c in R.STATE_FIELDS]


def recall_state_fold(
    log: DataFrame, initial: DataFrame | None = None, *, fold_events: int = FOLD_EVENTS, with_gap: bool = False
) -> DataFrame:
    """Final state per (owner, node), events applied in (time, id) order.

    Events rated outside 1..4 or without a time change nothing; :func:`valid_rating`
    gives the former.  Short logs are folded as one array.  A log above
    ``fold_events`` is cut into blocks of events that are merged independently, in
    two levels, with the same result.  ``with_gap`` keeps the gap, 1 - difficulty, for a
    later fold from these states.
    """
    log = valid_rating(log)[0].where(F.col("reviewed_at").isNotNull())

    def _columns_of(state: str) -> list[Column]:
        return [F.col(f"{state}.{c}").alias(c) for c in (*R.STATE_FIELDS, *(("gap",) if with_gap else ()))]

    def short(part: DataFrame) -> DataFrame:
        logs = _start(part.groupBy(*KEY).agg(_event_list()), initial)
        return logs.select(*KEY, F.aggregate("log", F.col("start"), _step).alias("state")).select(*KEY, *_columns_of("state"))

    hot, _ = hot_groups(log, KEY, fold_events)
    if hot is None:
        return with_next_review(short(log))
    cold_log, hot_log = split_hot(log, KEY, hot)
    opening, _, _, groups = _long_logs(hot_log, initial)
    whole = (
        groups.groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("_group", "block"))).alias("blocks"))
        .select(*KEY, _joined(F.col("blocks")).alias("block"))
    )
    long = opening.join(whole, KEY).select(*KEY, _apply(F.col("block"), F.col("state")).alias("state"))
    return with_next_review(short(cold_log).unionByName(long.select(*KEY, *_columns_of("state"))))


def with_next_review(states: DataFrame) -> DataFrame:
    return states.withColumn("next_review_at", R.next_review_at(F.col("last_review_at"), F.col("stability")))


def apply_reviews(nodes: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` after the reviews of ``log``, and the rejected reviews with a ``reason``, the first that applies.

    ``node_not_found`` if the sender has no such live node, ``invalid_rating`` outside 1..4, ``no_time`` without one.
    The others are folded onto the stored state in (time, id) order; right after a review recall is certain, so
    ``mastery_score`` is 1, and ``updated_at`` is the time of the last review.  Graded answers come as reviews by
    :func:`review_log`.  Columns that ``nodes`` lacks are left out, untouched nodes stay as they are.
    """
    live = nodes.where(~F.col("is_deleted")).select(F.col("owner_id").alias("_owner"), F.col("id").alias("_node"))
    found = log.join(live, (F.col("owner_id") == F.col("_owner")) & (F.col("node_id") == F.col("_node")), "left")
    reason = (
        F.when(F.col("_node").isNull(), F.lit("node_not_found"))
        .when(~F.coalesce(F.col("rating").isin(1, 2, 3, 4), F.lit(False)), F.lit("invalid_rating"))
        .when(F.col("reviewed_at").isNull(), F.lit("no_time"))
    )
    judged = kept(found.select(*log.columns, reason.alias("reason")), "judged-reviews")
    good = judged.where(F.col("reason").isNull()).drop("reason")
    stored = nodes.withColumnRenamed("id", "node_id").join(good.select(*KEY).distinct(), KEY, "left_semi")
    states = recall_state_fold(good, stored).withColumns({"mastery_score": F.lit(1.0), "updated_at": F.col("last_review_at")})
    names = [c for c in (*R.STATE_FIELDS, "next_review_at", "mastery_score", "updated_at") if c in nodes.columns]
    written = states.select(*[F.col(c).alias(f"_{c}") for c in (*KEY, *names)], F.lit(True).alias("_reviewed"))
    at = (F.col("owner_id") == F.col("_owner_id")) & (F.col("id") == F.col("_node_id"))
    kinds = {f.name: f.dataType for f in nodes.schema}
    values = {c: F.when(F.col("_reviewed"), F.col(f"_{c}").cast(kinds[c])).otherwise(F.col(c)) for c in names}
    after = nodes.join(written, at, "left").withColumns(values).select(*nodes.columns)
    return after, judged.where(F.col("reason").isNotNull())


def _states_along(log: Column, start: Column) -> Column:
    """(event_id, state) after each event of an ordered log."""
    none = F.struct(F.col("log")[0]["event_id"].alias("event_id"), start.alias("state"))
    empty = F.slice(F.array(none), 1, 0)

    def add(acc: Column, event: Column) -> Column:
        state = _step(acc["now"], event)
        entry = F.struct(event["event_id"].alias("event_id"), state.alias("state"))
        return F.struct(state.alias("now"), F.concat(acc["seen"], F.array(entry)).alias("seen"))

    return F.aggregate(log, F.struct(start.alias("now"), empty.alias("seen")), add, lambda acc: acc["seen"])


def _before_each(units: DataFrame, keys: list[str], at: str) -> DataFrame:
    """For each unit, the composition of the units before it under the same key."""
    ordered = units.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(at, "block"))).alias("units"))
    first = F.struct(F.col("units")[0][at].alias(at), _block_start().alias("before"))

    def add(acc: Column, unit: Column) -> Column:
        entry = F.struct(unit[at].alias(at), acc["now"].alias("before"))
        return F.struct(_then(acc["now"], unit["block"]).alias("now"), F.concat(acc["seen"], F.array(entry)).alias("seen"))

    seen = F.aggregate("units", F.struct(_block_start().alias("now"), F.slice(F.array(first), 1, 0).alias("seen")), add, lambda acc: acc["seen"])
    return ordered.select(*keys, F.explode(seen).alias("u")).select(*keys, F.col(f"u.{at}").alias(at), F.col("u.before").alias("before"))


def recall_state_history(log: DataFrame, initial: DataFrame | None = None, *, history_events: int = HISTORY_EVENTS) -> DataFrame:
    """State after every event with a valid rating and a time."""
    log = valid_rating(log)[0].where(F.col("reviewed_at").isNotNull())

    def listed(logs: DataFrame) -> DataFrame:
        states = logs.select(*KEY, F.explode(_states_along(F.col("log"), F.col("start"))).alias("e"))
        return states.select(*KEY, F.col("e.event_id").alias("event_id"), *_columns_of("e.state"))

    def short(part: DataFrame) -> DataFrame:
        return listed(_start(part.groupBy(*KEY).agg(_event_list()), initial))

    hot, _ = hot_groups(log, KEY, history_events)
    if hot is None:
        return with_next_review(short(log))
    cold_log, hot_log = split_hot(log, KEY, hot)
    opening, rest, blocks, groups = _long_logs(hot_log, initial)
    of_group = _before_each(groups, KEY, "_group").withColumnRenamed("before", "_earlier")
    of_block = _before_each(blocks, [*KEY, "_group"], "_block")
    entering = (
        of_block.join(of_group, [*KEY, "_group"])
        .join(opening.select(*KEY, "state"), KEY)
        .select(*KEY, "_group", "_block", _apply(_then(F.col("_earlier"), F.col("before")), F.col("state")).alias("start"))
    )
    later = listed(rest.join(entering, [*KEY, "_group", "_block"]))
    firsts = opening.select(*KEY, "event_id", *_columns_of("state"))
    return with_next_review(short(cold_log).unionByName(firsts).unionByName(later))


# --- reading the state ----------------------------------------------------------


def decayed(states: DataFrame, as_of: Column) -> DataFrame:
    """States with defaults filled in and ``mastery``: retrievability at ``as_of``."""
    clean = R.clean_state(*[F.col(c) for c in R.STATE_FIELDS])
    filled = states.withColumn("_s", clean).withColumns({c: F.col(f"_s.{c}") for c in R.STATE_FIELDS}).drop("_s")
    return filled.withColumn("mastery", R.retrievability(F.col("stability"), F.col("last_review_at"), as_of))


def due_nodes(states: DataFrame, as_of: Column) -> DataFrame:
    """Rows never reviewed, without stability, or past their due time."""
    return states.where(R.due(F.col("stability"), F.col("last_review_at"), F.col("next_review_at"), as_of))


def reviewed_on_day(states: DataFrame, as_of: Column) -> DataFrame:
    """Rows last reviewed on the UTC day of ``as_of``, as a range test on the column."""
    day = F.date_trunc("day", as_of)
    return states.where((F.col("last_review_at") >= day) & (F.col("last_review_at") < day + F.expr("interval 1 day")))


def review_stats(states: DataFrame, as_of: Column) -> DataFrame:
    """Totals, due, reviewed today, average stability and unseen nodes, per owner."""
    last, stability = F.col("last_review_at"), F.col("stability")
    state = F.col("review_state")
    average = F.coalesce(F.avg(F.when(stability > 0, stability)), F.lit(0.0))
    return states.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if(R.due(stability, last, F.col("next_review_at"), as_of)).alias("due_count"),
        F.count_if(F.to_date(last) == F.to_date(as_of)).alias("today_reviewed"),
        round_half_even(average, 2).alias("avg_stability"),
        F.count_if((state == "new") | state.isNull()).alias("new_count"),
    )


def due_queue(states: DataFrame, as_of: Column, limit: int = V.DEFAULT_LIMIT, *, only_due: bool = False) -> DataFrame:
    """Most urgent nodes of every owner: unseen first, then lowest retrievability.

    Only narrow columns are ranked; :func:`attach_content` adds the texts of the
    rows that remain.
    """
    rows = decayed(due_nodes(states, as_of) if only_due else states, as_of)
    rows = rows.select(
        "owner_id",
        "id",
        "name",
        round_half_even(F.col("mastery"), 4).alias("retrievability"),
        round_half_even(F.col("stability"), 4).alias("stability"),
        round_half_even(F.col("difficulty"), 4).alias("difficulty"),
        "review_count",
        "review_state",
        "next_review_at",
    )
    order = [(F.col("stability") > 0).asc(), F.col("retrievability").asc(), F.col("id").asc()]
    return top_rows(rows, ["owner_id"], order, limit)


def attach_content(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with the text of their node, empty if it has none."""
    texts = nodes.select("id", F.coalesce("content", F.lit("")).alias("content"))
    return rows.join(texts, "id")


def _questions_per_node(questions: DataFrame) -> DataFrame:
    return questions.groupBy("owner_id", F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("question_count"))


def question_counts(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions of every live node, 0 included."""
    live = nodes.where(~F.col("is_deleted")).select("owner_id", "id")
    return live.join(_questions_per_node(questions), ["owner_id", "id"], "left").fillna(0, ["question_count"])


def quiz_node_stats(states: DataFrame, questions: DataFrame, as_of: Column) -> DataFrame:
    """Decayed mastery, recall fields and question count of every live node."""
    live = decayed(states.where(~F.col("is_deleted")), as_of)
    counted = live.join(_questions_per_node(questions), ["owner_id", "id"], "left")
    return counted.select(
        "owner_id",
        "id",
        "name",
        round_half_even(F.col("mastery"), 4).alias("mastery_score"),
        round_half_even(F.col("stability"), 4).alias("stability"),
        round_half_even(F.col("difficulty"), 4).alias("difficulty"),
        "review_count",
        "review_state",
        F.coalesce("question_count", F.lit(0).cast("bigint")).alias("question_count"),
    )


def quiz_totals(questions: DataFrame, records: DataFrame) -> DataFrame:
    """Questions and answers per owner."""
    q = questions.groupBy("owner_id").agg(F.count(F.lit(1)).alias("total_questions"))
    a = records.groupBy("owner_id").agg(F.count(F.lit(1)).alias("total_answers"))
    return q.join(a, "owner_id", "full").fillna(0, ["total_questions", "total_answers"])


def learner_kpis(node_stats: DataFrame) -> DataFrame:
    """Coverage, mean mastery of reviewed nodes and mean positive stability, per owner."""
    reviewed = F.col("review_count") > 0
    mastery = F.avg(F.when(reviewed, F.col("mastery_score")))
    stability = F.avg(F.when(F.col("stability") > 0, F.col("stability")))
    return node_stats.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if(reviewed).alias("reviewed_nodes"),
        (F.count_if(reviewed) / F.count(F.lit(1))).alias("coverage"),
        F.coalesce(mastery, F.lit(0.0)).alias("avg_mastery"),
        round_half_up(F.coalesce(stability, F.lit(0.0)), 1).alias("avg_stability_days"),
    )


def growth_stages(kpis: DataFrame) -> DataFrame:
    return kpis.select("owner_id", R.growth_stage(F.col("coverage"), F.col("avg_stability_days")).alias("stage"))


def weak_nodes(node_stats: DataFrame, limit: int = V.WEAK_LIMIT) -> DataFrame:
    """Reviewed nodes with the lowest mastery below 1, per owner."""
    weak = node_stats.where((F.col("review_count") > 0) & (F.col("mastery_score") < 1))
    return top_rows(weak, ["owner_id"], [F.col("mastery_score"), F.col("id")], limit)


def activity_rate(node_stats: DataFrame) -> DataFrame:
    """Share of nodes with any mastery, per owner."""
    active = F.avg((F.col("mastery_score") > 0).cast("double"))
    return node_stats.groupBy("owner_id").agg(active.alias("activity_rate"))


def size_tiers(node_stats: DataFrame) -> DataFrame:
    counted = node_stats.groupBy("owner_id").agg(F.count(F.lit(1)).alias("node_count"))
    return counted.withColumn("tier", R.size_tier(F.col("node_count")).cast("bigint"))


def daily_review_counts(log: DataFrame) -> DataFrame:
    """Reviews per owner and UTC day."""
    day = F.date_format("reviewed_at", "yyyy-MM-dd").alias("day")
    return log.groupBy("owner_id", day).agg(F.count(F.lit(1)).alias("reviews"))
