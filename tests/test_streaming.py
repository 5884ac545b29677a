from datetime import datetime, timedelta
import random

from pyspark.sql import functions as F

from grovekeep.operators import recall
from grovekeep.streaming import jobs

LOG = "event_id long, owner_id string, node_id long, rating int, reviewed_at timestamp"
T0 = datetime(2024, 1, 1)


def write_files(spark, folder, batches, closed=True):
    """One file per batch, read back in order; a last one ends the stream."""
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in")
    if closed:
        jobs.closing_row(spark, stream.schema, "reviewed_at").write.mode("append").parquet(f"{folder}/in")
    return stream


def events(n, seed=1):
    rng = random.Random(seed)
    return [(i, "o", rng.randrange(4), rng.randrange(1, 5), T0 + timedelta(minutes=10 * i + rng.randrange(0, 40))) for i in range(n)]


def as_dict(df):
    return {r.node_id: (round(r.stability, 6), round(r.difficulty, 6), r.review_count, r.review_state, r.last_review_at, r.next_review_at) for r in df.collect()}


def split_late(batches, delay):
    """Rows in time for the mark, which trails the newest row of earlier batches, and the late ones."""
    good, late, newest = [], [], None
    for rows in batches:
        mark = newest - delay if newest is not None else None
        for row in rows:
            (late if mark is not None and row[4] < mark else good).append(row)
        newest = max([r[4] for r in rows] + ([newest] if newest else []))
    return good, late


def both_streams(stream):
    states, late = jobs.fold_stream(stream, 3600)
    changes = jobs.run_keyed(jobs.recall_state_changes(stream, "1 hour"))
    return (as_dict(states), {r.event_id for r in late.collect()}), (as_dict(jobs.current_states(changes)), {r.event_id for r in jobs.late_reviews(changes).collect()})


def test_streams_equal_the_batch_fold_without_the_late_rows(spark, tmp_path):
    rows = events(120)
    batches = [rows[:50], rows[50:80] + rows[100:110], rows[80:100] + rows[110:115], rows[115:] + events(3, seed=5)]
    batches[3][-3:] = [(900 + i, *r[1:]) for i, r in enumerate(batches[3][-3:])]
    good, late = split_late(batches, timedelta(hours=1))
    assert len(late) > 5
    want = as_dict(recall.recall_state_fold(spark.createDataFrame(good, LOG))), {r[0] for r in late}
    for got in both_streams(write_files(spark, tmp_path, batches)):
        assert got == want


def test_the_second_of_three_reviews_late(spark, tmp_path):
    """Reviews at one, two and three o'clock, the second late: the third is applied once, the second never."""
    rows = [(i, "o", 1, 4, T0 + timedelta(hours=i)) for i in (1, 2, 3)]
    batches = [[rows[0]], [rows[2]], [(9, "o", 2, 3, T0 + timedelta(hours=9))], [rows[1]]]
    want = as_dict(recall.recall_state_fold(spark.createDataFrame([rows[0], rows[2], batches[2][0]], LOG)))
    for states, late in both_streams(write_files(spark, tmp_path, batches)):
        assert states == want and states[1][2] == 2 and late == {2}


def test_reviews_wait_until_the_stream_is_closed(spark, tmp_path):
    rows = [(i, "o", 1, 3, T0 + timedelta(hours=i)) for i in range(5)]
    for states, late in both_streams(write_files(spark, tmp_path, [rows], closed=False)):
        assert states[1][2] == 3 and not late


def test_keyed_state_survives_a_restart(spark, tmp_path):
    """The query stops after each file and goes on from its checkpoint."""
    rows = events(60)
    batches = [rows[:20], rows[20:45], rows[45:]]
    for i in range(len(batches)):
        stream = write_files(spark, tmp_path, batches[i : i + 1], closed=i == 2)
        for key, value in jobs.STATE_STORE.items():
            spark.conf.set(key, value)
        running = (jobs.recall_state_changes(stream, "1 hour").writeStream.format("parquet").trigger(availableNow=True)
                   .option("path", f"{tmp_path}/table").option("checkpointLocation", f"{tmp_path}/checkpoint").start())
        running.awaitTermination()
    good, late = split_late(batches, timedelta(hours=1))
    changes = spark.read.parquet(f"{tmp_path}/table")
    assert as_dict(jobs.current_states(changes)) == as_dict(recall.recall_state_fold(spark.createDataFrame(good, LOG)))
    assert {r.event_id for r in jobs.late_reviews(changes).collect()} == {r[0] for r in late}


def test_rows_without_time_or_valid_rating_change_nothing(spark, tmp_path):
    good = events(40)
    bad = [(900, "o", 1, 3, None), (901, "o", 1, 0, T0), (902, "o", 2, None, T0), (903, "o", 2, 9, T0)]
    want = as_dict(recall.recall_state_fold(spark.createDataFrame(good, LOG)))
    assert as_dict(recall.recall_state_fold(spark.createDataFrame(good + bad, LOG))) == want
    for states, _ in both_streams(write_files(spark, tmp_path, [good[:20] + bad, good[20:]])):
        assert states == want


def test_exact_insertion_over_files_in_any_order(spark, tmp_path):
    files = [[(1, "o", 1, 3, T0 + timedelta(days=200))], [(5, "o", 1, 3, T0)], [(1, "o", 1, 2, T0 + timedelta(days=400)), (2, "o", 1, 3, T0)], [(3, "o", 1, 1, T0)]]
    table, opened = jobs.insert_stream(write_files(spark, tmp_path, files, closed=False), ["event_id"], ["reviewed_at"])
    assert sorted((r.event_id, r.rating) for r in table.collect()) == [(1, 3), (2, 3), (3, 1), (5, 3)]
    # Only the third batch meets a key that is there, in one folder.
    assert [r.batch for r in opened.collect()] == [2]


def test_insertion_opens_only_folders_that_may_hold_a_key(spark, tmp_path):
    """Many keys, some sent again: the result is exact, and most folders stay shut."""
    keys = list(range(4000))
    batches = [keys[:2000], [*range(2000, 2050)], [7, 8, 9, *range(2050, 2100)], [*range(1990, 2010), *range(2100, 4000)]]
    folder, expected = str(tmp_path), set()
    write = jobs.insert_new_rows(folder, ["k"], ["v"])
    for i, some in enumerate(batches):
        write(spark.createDataFrame([(k, i) for k in some], "k int, v int"), i)
        expected |= set(some)
    rows = spark.read.parquet(f"{folder}/rows").collect()
    assert sorted(r.k for r in rows) == sorted(expected)
    assert {r.k: r.v for r in rows}[7] == 0
    opened = spark.read.schema("folder string, batch int").parquet(f"{folder}/opened").collect()
    by_batch = [sum(r.batch == i for r in opened) for i in range(4)]
    # Fifty new keys over 64 buckets of 31 keys each: bitmaps rule nearly all folders out.
    assert by_batch[1] <= 3 and 3 <= by_batch[2] <= 8
    before = sorted(map(tuple, rows))
    write(spark.createDataFrame([(k, 3) for k in batches[3]], "k int, v int"), 3)
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/rows").collect())) == before


def test_late_reviews_are_set_aside(spark, tmp_path):
    early = [(i, "o", 1, 3, T0 + timedelta(days=i)) for i in range(5)]
    late = [(99, "o", 1, 1, T0 + timedelta(hours=1)), (100, "o", 1, 3, T0 + timedelta(days=6))]
    batches = [spark.createDataFrame(b, LOG) for b in (early, late)]
    fold = jobs.fold_batches(str(tmp_path), 3600)
    for i, batch in enumerate(batches):
        fold(batch, i)
    fold(batches[1], 1)
    state = spark.read.parquet(f"{tmp_path}/state").where("batch = 1").first()
    assert (state.review_count, state.review_state) == (5, "review")
    assert [r.event_id for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [99]
    assert [r.event_id for r in spark.read.parquet(f"{tmp_path}/pending").where("batch = 1").collect()] == [100]


def test_days_are_given_out_once_they_close(spark, tmp_path):
    """Counts of several batches are added up; a day closes when the mark has passed it, the last ones with the stream."""
    rows = [(i, "o", 1, 3, T0 + timedelta(hours=9 * i)) for i in range(8)]
    batches = [rows[:2], rows[2:4] + [(50, "p", 1, 1, None)], [*rows[4:], (51, "o", 1, 2, T0 + timedelta(hours=12))], [(52, "o", 1, 2, T0)]]
    closed, late = jobs.count_stream(write_files(spark, tmp_path, batches), 3600)
    days = {f"2024-01-0{d}": sum(r[4].day == d for r in rows) for d in (1, 2, 3)}
    # The second batch has closed the first day, so both rows that come after it are late; a row without a time is as well.
    assert sorted((r.day, r.reviews) for r in closed.collect()) == sorted(days.items())
    assert sorted(r.event_id for r in late.collect()) == [50, 51, 52]
    write = jobs.count_batches(str(tmp_path / "t"), 3600)
    frames = [spark.createDataFrame(b, LOG) for b in batches[:2]]
    write(frames[0], 0)
    assert spark.read.parquet(f"{tmp_path}/t/closed").count() == 0
    write(frames[1], 1)
    write(frames[1], 1)
    assert [(r.day, r.reviews) for r in spark.read.parquet(f"{tmp_path}/t/closed").collect()] == [("2024-01-01", days["2024-01-01"])]


def test_a_closing_row_closes_the_windows_too(spark, tmp_path):
    rows = [(i, "o", 1, 3, T0 + timedelta(hours=9 * i)) for i in range(8)]
    got = jobs.run_to_table(jobs.daily_review_counts(write_files(spark, tmp_path, [rows]), "1 hour")).collect()
    assert sorted((r.day, r.reviews) for r in got) == [("2024-01-01", 3), ("2024-01-02", 3), ("2024-01-03", 2)]


def test_a_key_is_taken_once_within_the_delay(spark, tmp_path):
    rows = [(1, "o", 1, 3, T0), (1, "o", 1, 3, T0 + timedelta(minutes=5)), (2, "o", 1, 3, T0)]
    stream = write_files(spark, tmp_path, [rows], closed=False)
    assert sorted(r.event_id for r in jobs.run_to_table(jobs.insert_ignore(stream, ["event_id"], "reviewed_at", "1 hour")).collect()) == [1, 2]


def test_keys_of_a_bucket_share_its_state(spark, tmp_path):
    """Many keys, some without an owner or an event id, in two buckets: as many timers and stored rows as buckets, not keys."""
    rows = [(None if i % 9 == 0 else i + (1 << 60), None if i % 7 == 0 else f"o{i % 4}", i % 25, i % 4 + 1, T0 + timedelta(minutes=37 * i)) for i in range(120)]
    stream = write_files(spark, tmp_path, [rows[:70], rows[70:]])
    changes = jobs.run_keyed(jobs.recall_state_changes(stream, "1 hour", buckets=2))
    folded = lambda df: {(r.owner_id, r.node_id, round(r.stability, 6), round(r.difficulty, 6), r.review_count, r.review_state, r.last_review_at) for r in df.collect()}
    assert folded(jobs.current_states(changes)) == folded(recall.recall_state_fold(spark.createDataFrame(rows, LOG)))
    assert changes.where("kind = 'state'").select("owner_id", "node_id").dtypes == [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame(rows, LOG).select("owner_id", "node_id").schema]
    late = [(1 << 60, "o0", 1, 3, T0 - timedelta(days=9)), (None, None, 2, 3, T0 - timedelta(days=9))]
    again = write_files(spark, tmp_path / "late", [rows[:70], rows[70:] + late])
    changes = jobs.run_keyed(jobs.recall_state_changes(again, "1 hour", buckets=2))
    got = {(r.event_id, r.owner_id, r.node_id) for r in jobs.late_reviews(changes).collect()}
    assert got == {r[:3] for r in late}
