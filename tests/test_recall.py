from datetime import datetime, timedelta
import math
import random

import pytest
from pyspark.sql import functions as F

from grovekeep.functions import recall as R
from grovekeep.functions.scalars import parse_time, round_half_even
from grovekeep.operators import keyed, recall

LOG = "event_id long, owner_id string, node_id long, rating int, reviewed_at timestamp"
START = datetime(2024, 1, 1)


def by_hand(ratings, s=0.0, d=0.3, n=0, state="new"):
    """Expected state, worked out rule by rule."""
    for r in ratings:
        d = min(1.0, max(0.01, d + 0.15 * (3 - r) * (1 - d)))
        if n == 0 or s <= 0:
            s = {1: 0.5, 2: 1.0, 3: 2.0, 4: 4.0}[r]
        else:
            s = {1: max(0.5, s * 0.5), 2: s * 1.3, 3: s * 2.5, 4: s * 4.0}[r]
        state = "review" if state == "new" else "relearning" if r == 1 else "review" if r >= 3 else state
        n += 1
    return s, d, n, state


def log_of(spark, logs):
    rows, event = [], 0
    for key, ratings in logs.items():
        for i, r in enumerate(ratings):
            rows.append((event, "o", key, r, START + timedelta(minutes=i // 2)))
            event += 1
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize("rating,s,d", [(1, 0.5, 0.51), (2, 1.0, 0.405), (3, 2.0, 0.3), (4, 4.0, 0.195)])
def test_first_review(spark, rating, s, d):
    row = recall.recall_state_fold(log_of(spark, {1: [rating]})).first()
    assert (row.stability, row.review_count, row.review_state) == (s, 1, "review")
    assert row.difficulty == pytest.approx(d)
    assert row.next_review_at == START + timedelta(seconds=int(s * 0.10536 * 86400))


def test_relearning(spark):
    rows = {r.node_id: r for r in recall.recall_state_fold(log_of(spark, {1: [3, 1], 2: [3, 1, 2], 3: [3, 1, 3], 4: [1, 1]})).collect()}
    assert [rows[k].review_state for k in (1, 2, 3, 4)] == ["relearning", "relearning", "review", "relearning"]
    assert rows[1].stability == 1.0 and rows[4].stability == 0.5


@pytest.mark.parametrize("fold_events", [1, 7, 10**6])
def test_fold_matches_rules_whatever_the_cut(spark, monkeypatch, fold_events):
    monkeypatch.setattr(recall, "BLOCK", 3)
    rng = random.Random(fold_events)
    logs = {k: [rng.randint(1, 4) for _ in range(rng.randint(1, 60))] for k in range(12)}
    rows = recall.recall_state_fold(log_of(spark, logs), fold_events=fold_events).collect()
    assert len(rows) == len(logs)
    for row in rows:
        s, d, n, state = by_hand(logs[row.node_id])
        assert row.stability == pytest.approx(s, rel=1e-9) and row.difficulty == pytest.approx(d, rel=1e-9)
        assert (row.review_count, row.review_state) == (n, state)


@pytest.mark.parametrize("history_events", [1, 5, 10**6])
def test_history_matches_rules_whatever_the_cut(spark, monkeypatch, history_events):
    monkeypatch.setattr(recall, "BLOCK", 4)
    rng = random.Random(3)
    logs = {k: [rng.randint(1, 4) for _ in range(rng.randint(1, 40))] for k in range(8)}
    log = log_of(spark, logs)
    rows = recall.recall_state_history(log, history_events=history_events).collect()
    assert len(rows) == log.count()
    for row in rows:
        s, d, n, state = by_hand(logs[row.node_id][: row.review_count])
        assert row.stability == pytest.approx(s, rel=1e-9) and row.difficulty == pytest.approx(d, rel=1e-9)
        assert row.review_state == state


def test_fold_continues_a_stored_state(spark):
    ratings = [3, 2, 1, 4, 3, 1, 2]
    whole = recall.recall_state_fold(log_of(spark, {1: ratings})).first()
    log = log_of(spark, {1: ratings})
    first, rest = log.where("event_id < 3"), log.where("event_id >= 3")
    for fold_events in (1, 100):
        resumed = recall.recall_state_fold(rest, recall.recall_state_fold(first), fold_events=fold_events).first()
        assert resumed.difficulty == pytest.approx(whole.difficulty)
        assert resumed.asDict() | {"difficulty": 0} == whole.asDict() | {"difficulty": 0}


def test_stability_may_overflow(spark):
    ratings = [4] * 600 + [1] * 1200
    for fold_events in (10, 10**6):
        row = recall.recall_state_fold(log_of(spark, {1: ratings}), fold_events=fold_events).first()
        assert math.isinf(row.stability) and row.next_review_at.year == 9999


def test_stored_zero_difficulty_is_the_default(spark):
    state = R.clean_state(F.lit(0.0), F.lit(0.0), F.lit(None), F.lit(""), F.lit(None))
    row = spark.range(1).select(R.fsrs_step(state, F.lit(3), F.lit(START)).alias("s")).first().s
    assert (round(row.difficulty, 12), row.review_count, row.review_state) == (0.3, 1, "review")


def test_retrievability_edges(spark):
    now = F.lit(datetime(2024, 1, 31)).cast("timestamp")
    rows = spark.createDataFrame([(2.0, None), (2.0, datetime(2024, 2, 5)), (0.0, datetime(2024, 1, 1)), (2.0, datetime(2024, 1, 29))],
                                 "s double, t timestamp")
    got = [r[0] for r in rows.select(R.retrievability(F.col("s"), F.col("t"), now)).collect()]
    assert got == pytest.approx([0.0, 1.0, 0.0, math.exp(-1)])
    assert spark.range(1).select(parse_time(F.lit("not a time"))).first()[0] is None


def test_rounding_goes_to_even_on_exact_ties(spark):
    cases = [(0.03125, 4), (0.09375, 4), (0.125, 2), (0.375, 2), (2.5, 0), (0.33333, 4), (-0.03125, 4)]
    for x, digits in cases:
        got = spark.range(1).select(round_half_even(F.lit(x), digits)).first()[0]
        assert got == round(x, digits), (x, digits)


def test_stability_labels(spark):
    rows = spark.createDataFrame([(0.0,), (0.5,), (0.99,), (1.0,), (29.4,), (30.0,), (100.0,)], "s double")
    assert [r[0] for r in rows.select(R.format_stability(F.col("s"))).collect()] == ["未复习", "12小时", "24小时", "1天", "29天", "1月", "3月"]


def test_due_queue_puts_unseen_first(spark):
    at = datetime(2024, 1, 31)
    rows = [("o", i, "n", s, 0.3, c, "review", t, None) for i, s, c, t in
            [(1, 5.0, 1, at - timedelta(days=1)), (2, 0.0, 0, None), (3, 5.0, 1, at - timedelta(days=9)), (4, 1.0, 1, at - timedelta(days=30))]]
    states = spark.createDataFrame(rows, "owner_id string, id long, name string, stability double, difficulty double, review_count long, "
                                         "review_state string, last_review_at timestamp, next_review_at timestamp")
    got = recall.due_queue(states, F.lit(at), 3).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 4, 3]


def test_growth_stages(spark):
    rows = spark.createDataFrame([(0.0, 50.0), (0.2, 50.0), (0.5, 4.0), (0.5, 50.0), (0.95, 10.0), (0.95, 20.0)], "c double, s double")
    got = [r[0][:2] for r in rows.select(R.growth_stage(F.col("c"), F.col("s"))).collect()]
    assert got == ["种子", "萌芽", "生长", "生长", "繁茂", "参天"]


@pytest.mark.parametrize("runs", [[(1, 1200), (4, 1300)], [(4, 2600)], [(1, 2600)], [(3, 2600)], [(2, 300), (4, 400), (1, 1900)]])
@pytest.mark.parametrize("stored", [None, 1.0, 0.01])
def test_long_runs_have_one_result(spark, runs, stored):
    """Arrays, blocks and histories agree however long a log is."""
    ratings = [r for r, n in runs for _ in range(n)]
    rows = [(i, "o", 1, r, START + timedelta(minutes=i)) for i, r in enumerate(ratings)]
    log = spark.createDataFrame(rows, "event_id long, owner_id string, node_id long, rating int, reviewed_at timestamp")
    initial = None
    if stored is not None:
        initial = spark.createDataFrame([("o", 1, 1.0, stored, 1, "review", START)], "owner_id string, node_id long, stability double, difficulty double, review_count long, review_state string, last_review_at timestamp")
    whole = recall.recall_state_fold(log, initial).first()
    blocks = recall.recall_state_fold(log, initial, fold_events=100).first()
    last = recall.recall_state_history(log, initial, history_events=100).where(F.col("event_id") == len(rows) - 1).first()
    for other in (blocks, last):
        assert other.difficulty == pytest.approx(whole.difficulty, rel=1e-9)
        assert other.stability == pytest.approx(whole.stability, rel=1e-9) or other.stability == whole.stability
        assert (other.review_count, other.review_state) == (whole.review_count, whole.review_state)


def test_top_rows_beyond_the_group_limit(spark):
    """A large ``n`` gives the rows and ranks of the plain window."""
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'a', 'b') AS owner_id")
    top = keyed.top_rows(rows, ["owner_id"], [F.col("id").desc()], 1500)
    got = sorted((r.owner_id, r.rank, r.id) for r in top.collect())
    want = [("a", i + 1, 2997 - 3 * i) for i in range(1000)]
    rest = [i for i in range(2999, -1, -1) if i % 3][:1500]
    assert got == want + [("b", i + 1, v) for i, v in enumerate(rest)]
