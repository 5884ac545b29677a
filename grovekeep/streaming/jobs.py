"""Structured Streaming over review and attempt streams.

A stream that ends is closed by a row: one whose time is ``CLOSING`` or later (:func:`closing_row`) moves
the watermark past everything, so what still waits is worked off by the state itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import fixed_values as V
from ..operators.keyed import first_rows, last_rows
from ..operators.recall import KEY, recall_state_fold, with_next_review
from ..scratch import new_path

CLOSING = "9000-01-01 00:00:00"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def closing_row(spark: SparkSession, schema, event_time: str) -> DataFrame:
    """One row, null but for its time, that ends a stream."""
    return spark.range(1).select(*[(F.lit(CLOSING) if f.name == event_time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _closes(event_time: str) -> Column:
    return F.coalesce(F.col(event_time) >= F.lit(CLOSING).cast("timestamp"), F.lit(False))


# Keys that share a bucket are called, timed and stored together: a call costs far more than a review.
KEY_BUCKETS = 2048


def _review_folder(keys: list[str], rate: float, low: float, start: float, first: dict, factor: dict, lapse: float) -> StatefulProcessor:
    """The processor of :func:`recall_state_changes`; a group is a bucket of keys, whose values come as text.

    It is made here from plain values, so workers need no copy of this package.
    """
    names = [f"key{i}" for i in range(len(keys))]
    held = {"now": ("stability double", "gap double", "count bigint", "state string", "last_us bigint"), "waiting": ("at_us bigint", "event_id bigint", "rating int")}

    class ReviewFolder(StatefulProcessor):
        """Holds the reviews of a bucket's keys until the watermark has passed them, then applies them in order."""

        def init(self, handle) -> None:
            self.handle = handle
            # One row per bucket, an array per column: it is read and written in one call.
            of = {name: ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in [*[f"{k} string" for k in names], *columns]) for name, columns in held.items()}
            self.now = handle.getValueState("now", of["now"])
            self.waiting = handle.getValueState("waiting", of["waiting"])

        def stored(self, state) -> list[tuple]:
            return list(zip(*state.get(), strict=True)) if state.exists() else []

        def store(self, state, rows: list[tuple]) -> None:
            if rows:
                state.update(tuple(list(column) for column in zip(*rows, strict=True)))
            else:
                state.clear()

        def advance(self, stability: float, gap: float, count: int, state: str, rating: int) -> tuple:
            """One review on plain numbers; the same rules as ``functions.recall``."""
            gap = min(1.0 - low, (1.0 - rate * (3 - rating)) * gap)
            if count == 0 or stability <= 0:
                stability = first[rating]
            else:
                stability *= factor[rating]
                stability = max(lapse, stability) if rating == 1 else stability
            if state == "new" or (state == "relearning" and rating >= 3):
                state = "review"
            elif rating == 1:
                state = "relearning"
            return stability, gap, count + 1, state

        def frame(self, rows: list[tuple]) -> pd.DataFrame:
            columns = ["kind", *keys, "event_id", "stability", "difficulty", "review_count", "review_state", "last_review_at", "gap"]
            frame = pd.DataFrame(rows, columns=columns).astype({"event_id": "Int64", "review_count": "Int64", "stability": float, "difficulty": float, "gap": float})
            frame["last_review_at"] = pd.to_datetime(frame["last_review_at"], unit="us")
            return frame

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            passed, fresh, late = timerValues.getCurrentWatermarkInMs() * 1000, [], []
            for chunk in rows:
                events = (None if unnamed else event for event, unnamed in zip(chunk["event_id"].tolist(), chunk["unnamed"].tolist(), strict=True))
                of = zip(*[chunk[n].tolist() for n in names], strict=True)
                for whose, at, event, rating in zip(of, chunk["at_us"].tolist(), events, chunk["rating"].tolist(), strict=True):
                    if at < passed:
                        late.append(("late", *whose, event, None, None, None, None, at, None))
                    else:
                        fresh.append((*whose, at, event, rating))
            if fresh:
                self.store(self.waiting, self.stored(self.waiting) + fresh)
                # A timer goes off in the first batch whose watermark has reached it.
                self.handle.registerTimer(min(f[-3] for f in fresh) // 1000 + 1)
            if late:
                yield self.frame(late)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            waiting = self.stored(self.waiting)
            due = sorted((w for w in waiting if w[-3] < passed), key=lambda w: (w[-3], w[-2] is not None, w[-2] or 0, w[-1]))
            if not due:
                return
            now = {row[: len(keys)]: row[len(keys) :] for row in self.stored(self.now)}
            for *whose, at, _, rating in due:
                *before, _ = now.get(tuple(whose), (0.0, 1.0 - start, 0, "new", None))
                now[tuple(whose)] = (*self.advance(*before, rating), at // 1_000_000 * 1_000_000)
            self.store(self.now, [(*whose, *state) for whose, state in now.items()])
            left = [w for w in waiting if w[-3] >= passed]
            self.store(self.waiting, left)
            if left:
                self.handle.registerTimer(min(w[-3] for w in left) // 1000 + 1)
            changed = dict.fromkeys(tuple(w[: len(keys)]) for w in due)
            yield self.frame([("state", *whose, None, s, 1.0 - gap, count, state, last, gap) for whose in changed for s, gap, count, state, last in [now[whose]]])

        def close(self) -> None:
            pass

    return ReviewFolder()


def recall_state_changes(reviews: DataFrame, delay: str, *, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Changes of recall state of a review stream, and the reviews that came too late, told apart by ``kind``.

    Reviews are applied in (time, id) order once the watermark, ``delay`` behind the newest event, has
    passed them: a row of kind ``state`` per key and advance.  A review that comes after the watermark has passed
    its time is not applied; it comes out as a row of kind ``late``.  Event-time timers wake a bucket of keys when
    its next review is due, and a closing row wakes all of them.  State per bucket is the current
    state of its keys and the reviews that wait, in the session's state store: :func:`run_keyed` uses RocksDB.
    A batch reads and writes the states of the buckets it touches, so ``buckets`` should grow with the keys; a stream
    keeps the number it was started with.
    Rows without a valid rating or a time change nothing.  This is the low-latency form; :func:`fold_batches`
    suits large batches.
    """
    kinds = [reviews.schema[k].dataType.simpleString() for k in KEY]
    out = (
        f"kind string, {KEY[0]} string, {KEY[1]} string, event_id bigint, stability double, difficulty double, "
        "review_count bigint, review_state string, last_review_at timestamp, gap double"
    )
    marked = reviews.where(F.col("reviewed_at").isNotNull()).withWatermark("reviewed_at", delay)
    # Closing rows go once the watermark has seen them: a test that does not name the time would be pushed below it.
    # The time itself goes too, or late rows would be dropped unseen.
    valid = F.coalesce(F.col("rating").isin(1, 2, 3, 4), F.lit(False))
    sound = marked.where(F.when(F.col("reviewed_at") < F.lit(CLOSING).cast("timestamp"), valid).otherwise(F.lit(False)))
    # Integers with nulls would come to Python as floats and nulls as values unequal to themselves, so keys come as marked
    # text, a null one as the empty text, and a missing event id has a mark.
    plain = sound.select(
        F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket"), *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")).alias(f"key{i}") for i, k in enumerate(KEY)],
        F.coalesce(F.col("event_id").cast("bigint"), F.lit(0)).alias("event_id"), F.col("event_id").isNull().alias("unnamed"),
        F.col("rating").cast("int").alias("rating"), F.unix_micros("reviewed_at").alias("at_us"),
    )
    folder = _review_folder(
        KEY, V.DIFFICULTY_RATE, V.DIFFICULTY_FLOOR, V.START_DIFFICULTY,
        V.FIRST_STABILITY, V.STABILITY_FACTOR, V.LAPSE_STABILITY_FLOOR,
    )
    changes = plain.groupBy("bucket").transformWithStateInPandas(folder, out, "append", "eventtime")
    return changes.withColumns({k: F.when(F.col(k) != "", F.substr(k, F.lit(2))).cast(kind) for k, kind in zip(KEY, kinds, strict=True)})


def run_keyed(stream: DataFrame) -> DataFrame:
    """:func:`run_to_table` with the state of the query in RocksDB."""
    conf = stream.sparkSession.conf
    before = {key: conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        conf.set(key, value)
    try:
        return run_to_table(stream)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def current_states(changes: DataFrame) -> DataFrame:
    """The last state of every key of a table of :func:`recall_state_changes`."""
    states = changes.where(F.col("kind") == "state").drop("kind", "event_id")
    return with_next_review(last_rows(states, KEY, ["review_count"])).drop("gap")


def late_reviews(changes: DataFrame) -> DataFrame:
    """owner_id, node_id, event_id and reviewed_at (as it came) of the reviews that came too late."""
    return changes.where(F.col("kind") == "late").select(*KEY, "event_id", F.col("last_review_at").alias("reviewed_at"))


class BatchTables:
    """Tables of a batch writer: one folder per table and batch, rewritten when the batch is replayed."""

    def __init__(self, path: str, batch: DataFrame, batch_id: int) -> None:
        self.path, self.spark, self.batch_id = path, batch.sparkSession, batch_id

    def store(self, df: DataFrame, name: str, *partitions: str) -> DataFrame:
        at = f"{self.path}/{name}/batch={self.batch_id}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def before(self, name: str, schema) -> DataFrame:
        """What the batch before has stored."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/batch={self.batch_id - 1}")

    def passed(self) -> int | None:
        """The mark after the batch before, in microseconds."""
        return self.before("mark", "mark bigint").first()["mark"] if self.batch_id > 0 else None

    def mark(self, batch: DataFrame, event_time: str, delay_seconds: int) -> int | None:
        """The mark after this batch: the newest time less the delay, never before the last one; a closing row moves it past all."""
        at, last = F.unix_micros(event_time), self.passed()
        newest = F.when(F.max(_closes(event_time)), F.max(at)).otherwise(F.max(at) - delay_seconds * 1_000_000)
        return self.store(batch.agg(F.greatest(newest, F.lit(last).cast("bigint")).alias("mark")), "mark").first()["mark"]


def fold_batches(path: str, delay_seconds: int) -> Callable[[DataFrame, int], None]:
    """Batch writer that folds a review stream with native expressions only.

    Tables under ``path``, each with one folder per batch:
    ``state`` the state of every key; ``pending`` reviews newer than the mark,
    which trails the newest review by ``delay_seconds``; ``mark`` that time;
    ``late`` reviews that came after the mark had passed them; ``rejected`` reviews
    without a valid rating or a time.  A closing row moves the mark past all reviews.
    A batch reads what the batch before it left and rewrites its own folders when replayed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tables = BatchTables(path, batch, batch_id)
        every = batch.select(*KEY, "event_id", "rating", "reviewed_at")
        sound = F.coalesce(F.col("rating").isin(1, 2, 3, 4), F.lit(False)) & F.col("reviewed_at").isNotNull()
        tables.store(every.where(~sound & ~_closes("reviewed_at")), "rejected")
        fresh = every.where(sound & ~_closes("reviewed_at"))
        at, initial, passed = F.unix_micros("reviewed_at"), None, tables.passed()
        if batch_id > 0:
            initial = batch.sparkSession.read.parquet(f"{path}/state/batch={batch_id - 1}")
        late = F.lit(False) if passed is None else at < passed
        tables.store(fresh.where(late), "late")
        waiting = fresh.where(~late)
        if batch_id > 0:
            waiting = waiting.unionByName(tables.before("pending", fresh.schema))
        waiting = tables.store(waiting, "waiting")
        mark = tables.mark(every.where(sound | _closes("reviewed_at")), "reviewed_at", delay_seconds)
        due = F.lit(False) if mark is None else at < mark
        tables.store(waiting.where(~due), "pending")
        states = recall_state_fold(waiting.where(due), initial, with_gap=True)
        if initial is not None:
            states = initial.join(states.select(*KEY), KEY, "left_anti").unionByName(states)
        tables.store(states, "state")

    return write


def run_batches(stream: DataFrame, writer: Callable[[str], Callable[[DataFrame, int], None]]) -> str:
    """Process all available input through a batch writer; the folder of its tables."""
    path = new_path(stream.sparkSession, "stream")
    running = (
        stream.writeStream.foreachBatch(writer(f"{path}/tables")).trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/checkpoint").start()
    )
    running.awaitTermination()
    return f"{path}/tables"


def fold_stream(reviews: DataFrame, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Process all available reviews through :func:`fold_batches`: the states after the last one, and the late reviews.

    Reviews that the mark has not passed still wait, unless a closing row has ended the stream.
    """
    path = run_batches(reviews, lambda at: fold_batches(at, delay_seconds))
    spark = reviews.sparkSession
    states = spark.read.parquet(f"{path}/state")
    last = states.agg(F.max("batch")).first()[0]
    states = states.where(F.col("batch") == last)
    return states.drop("batch", "gap"), spark.read.parquet(f"{path}/late").drop("batch")


def count_batches(path: str, delay_seconds: int) -> Callable[[DataFrame, int], None]:
    """Batch writer that counts reviews per owner and UTC day, each day given out once.

    A batch stores its own counts in ``partial``, in a folder per day.  The mark trails the
    newest review; days that it passes are added up from their folders alone and go to ``closed``.
    Reviews of a day closed before, and those without a time, go to ``late``.  A closing row closes all days.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tables = BatchTables(path, batch, batch_id)
        every = batch.where(~_closes("reviewed_at")).select("owner_id", "event_id", "reviewed_at", F.date_format("reviewed_at", "yyyy-MM-dd").alias("day"))
        passed = tables.passed()
        day_end = F.unix_micros(F.date_trunc("day", "reviewed_at")) + 86_400_000_000
        late = F.col("reviewed_at").isNull() if passed is None else F.coalesce(day_end <= passed, F.lit(True))
        tables.store(every.where(late), "late")
        counts = every.where(~late).groupBy("owner_id", "day").agg(F.count(F.lit(1)).alias("reviews"))
        tables.store(counts, "partial", "day")
        mark = tables.mark(batch.select("reviewed_at"), "reviewed_at", delay_seconds)
        so_far = batch.sparkSession.read.schema("owner_id " + batch.schema["owner_id"].dataType.simpleString() + ", reviews bigint, batch int, day string").parquet(f"{path}/partial")
        # The day is a folder: only those that close now are read.
        first, last = (None if m is None else F.date_format(F.timestamp_micros(F.lit(m)), "yyyy-MM-dd") for m in (passed, mark))
        closing = F.lit(False) if mark is None else F.col("day") < last
        if passed is not None:
            closing &= F.col("day") >= first
        closed = so_far.where((F.col("batch") <= batch_id) & closing).groupBy("owner_id", "day").agg(F.sum("reviews").alias("reviews"))
        tables.store(closed, "closed")

    return write


def count_stream(reviews: DataFrame, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Counts of the closed days, and the late reviews, of all available input; see :func:`count_batches`."""
    path = run_batches(reviews, lambda at: count_batches(at, delay_seconds))
    spark = reviews.sparkSession
    return spark.read.parquet(f"{path}/closed").drop("batch"), spark.read.parquet(f"{path}/late").drop("batch")


def daily_review_counts(reviews: DataFrame, delay: str) -> DataFrame:
    """Reviews per owner and UTC day, each day emitted once it is closed."""
    day = F.window("reviewed_at", "1 day")
    counts = reviews.withWatermark("reviewed_at", delay).groupBy("owner_id", day).agg(F.count(F.lit(1)).alias("reviews"))
    return counts.select("owner_id", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "reviews")


def insert_ignore(rows: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """First arrival of each key, for rows that arrive in event order.

    A key is remembered for ``delay`` of event time and rows later than that are
    dropped; :func:`insert_new_rows` is exact for any order.
    """
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


BUCKETS = 64
# A filter has this many bits per bucket and batch; one key sets one.
FILTER_BITS = 32768


def _key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def _bit(h: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(FILTER_BITS))


def insert_new_rows(path: str, keys: list[str], order: list[str], *, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch writer that adds rows whose key the table at ``path`` lacks, the first of each key.

    Exact for keys of any age.  ``rows`` holds what each batch has added, in a folder per
    batch and bucket of the key's hash; ``filters`` a bitmap of the hashes in each such folder.  A batch looks its
    keys up in the bitmaps and opens the folders that may hold one of them, and no other.  A batch owns
    its folders and rewrites them when replayed, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, tables = batch.sparkSession, BatchTables(path, batch, batch_id)
        hashed = first_rows(batch, keys, order).withColumn("_hash", _key_hash(keys))
        hashed = tables.store(hashed.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int")), "incoming")
        fresh = hashed
        if batch_id > 0:
            filters = spark.read.schema("bucket int, bits binary, batch int").parquet(f"{path}/filters").where(F.col("batch") < batch_id)
            asked = hashed.select(F.col("_bucket").alias("bucket"), _bit(F.col("_hash")).alias("bit")).distinct()
            byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            met = asked.join(filters, "bucket").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
            # One row per folder that may hold a key: at most buckets times batches.
            folders = [f"{path}/rows/batch={r.batch}/_bucket={r.bucket}" for r in met.select("batch", "bucket").distinct().collect()]
            opened = spark.createDataFrame([(f,) for f in sorted(folders)], "folder string")
            tables.store(opened, "opened")
            if folders:
                stored = spark.read.schema(batch.select(*keys).schema).parquet(*folders)
                fresh = hashed.join(stored, keys, "left_anti")
        fresh = tables.store(fresh.drop("_hash").repartition("_bucket"), "rows", "_bucket")
        bits = fresh.groupBy(F.col("_bucket").alias("bucket")).agg(F.bitmap_construct_agg(_bit(_key_hash(keys))).alias("bits"))
        tables.store(bits, "filters")

    return write


def insert_stream(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table that :func:`insert_new_rows` makes of all available input, and the folders that its batches opened."""
    path = run_batches(rows, lambda at: insert_new_rows(at, keys, order))
    spark = rows.sparkSession
    return spark.read.parquet(f"{path}/rows").drop("batch", "_bucket"), spark.read.schema("folder string, batch int").parquet(f"{path}/opened")


def wrong_attempts(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Wrong attempts of a stream, with the question's owner and text."""
    asked = questions.select(F.col("id").alias("question_id"), "owner_id", "node_id", "question", "question_type", "difficulty")
    wrong = attempts.where(~F.col("is_correct")).select("question_id", "answered_at")
    return wrong.join(asked, "question_id")


def run_to_table(stream: DataFrame) -> DataFrame:
    """Process all available input into a parquet table and return the table."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    running = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
