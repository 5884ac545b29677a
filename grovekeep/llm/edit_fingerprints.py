"""Document fingerprints by randomised edit embedding.

A pointer walks over a text.  At step j it reads the character it points at, and a
random bit that depends on j and the character, the same for all texts, says
whether it moves on.  The characters read are the embedding.  After an insertion
or deletion, two walks soon fall into step again, so texts at a small edit distance
have embeddings at a small Hamming distance.

A fingerprint samples the embedding: of the steps 2^k to 2^(k+1) - 1 the same
``SAMPLES`` at most for all texts, each as a hex digit that hashes the character
read.  It covers the whole walk and therefore the whole text.  Likeness weighs each
such octave by the steps in it.  Bands of sampled digits propose candidates, which
are verified by likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import kept
from .common import whole_text
from .textarrays import BASE, mix

SAMPLES = 64
CLASSES = 64
SHORT_DIGITS = 5  # at most, in bands of octaves with fewer than SAMPLES steps
PERIOD = 4096
BUFFER = 8_000_000

_random = np.random.default_rng(20240229)
# A walk moves on two steps in three.
_moves = np.concatenate([_random.integers(0, 3, (PERIOD, CLASSES)) > 0, np.zeros((PERIOD, 1), bool)], axis=1).astype(np.int64)
_digits = _random.integers(0, 16, CLASSES).astype(np.uint8)
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def octave_steps(octave: int) -> np.ndarray:
    """The sampled steps of an octave, rising."""
    low = 1 << octave
    if low <= SAMPLES:
        return np.arange(low, 2 * low)
    return np.sort(np.random.default_rng(octave).choice(low, SAMPLES, replace=False)) + low


def classes(text: str) -> np.ndarray:
    """Each character as one of ``CLASSES`` classes by a hash."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (mix(codes.astype(np.uint64) + np.uint64(0x1234567)) % np.uint64(CLASSES)).astype(np.uint8)


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text: ``octave`` after octave of sampled digits, as far as its walk goes; empty for an empty text."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    parts = [classes(texts[i]) for i in order]
    lengths = np.array([len(p) for p in parts], np.int64)
    # After each text stands a class of its own on which no walk moves.
    data = np.concatenate([np.append(p, np.uint8(CLASSES)) for p in parts]) if parts else np.zeros(0, np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1].astype(np.int64)
    out: list[list[bytes]] = [[] for _ in texts]
    live = int((lengths > 0).sum())
    pointer = starts[:live].copy()
    rows = np.arange(live)
    ends = starts[:live] + lengths[:live]
    step, octave = 1, 0
    while len(rows):
        wanted = octave_steps(octave)
        read = np.full((len(wanted), len(rows)), CLASSES, np.uint8)
        place, stop = 0, 2 << octave
        while step < stop:
            # Up to the next sampled step, or for a while, without looking at who has ended.
            until = min(stop, step + 256)
            width = len(pointer)
            here = np.empty(width, np.uint8)
            move = np.empty(width, np.int64)
            for j in range(step, until):
                np.take(data, pointer, out=here, mode="clip")
                if place < len(wanted) and wanted[place] == j:
                    read[place, :width] = here
                    place += 1
                np.take(_moves[j % PERIOD], here, out=move, mode="clip")
                pointer += move
            step = until
            # Texts are in falling order of length, so those at the end of the list end first, about.
            going = np.flatnonzero(pointer < ends[: len(pointer)])
            pointer = pointer[: int(going[-1]) + 1] if len(going) else pointer[:0]
            if not len(pointer):
                step = stop
        symbols = np.where(read < CLASSES, HEX[_digits[np.minimum(read, CLASSES - 1)]], np.uint8(ord("-")))
        for i, r in enumerate(rows):
            out[order[r]].append(symbols[:, i].tobytes())
        rows, ends = rows[: len(pointer)], ends[: len(pointer)]
        octave += 1
    return [b"".join(p).rstrip(b"-").decode() for p in out]


def likeness(left: str, right: str) -> float:
    """Estimated share of steps at which two walks read alike, what chance makes alike taken off; 1 for equal fingerprints."""
    if left == right:
        return 1.0
    size = max(len(left), len(right))
    a = np.frombuffer(left.ljust(size, "-").encode(), np.uint8)
    b = np.frombuffer(right.ljust(size, "-").encode(), np.uint8)
    equal = (a == b) & (a != ord("-"))
    used = (a != ord("-")) | (b != ord("-"))
    total = alike = 0.0
    at, octave = 0, 0
    while at < size:
        n = min(1 << octave, SAMPLES)
        u = int(used[at : at + n].sum())
        weight = (1 << octave) / n
        total += weight * u
        alike += weight * int(equal[at : at + n].sum())
        at, octave = at + n, octave + 1
    chance = 1 / 8
    return float(min(1.0, max(0.0, (alike / total - chance) / (1 - chance)))) if total else 1.0


def edited_text(text: str, following: str) -> str:
    """The last third of the characters (rounded down) replaced by as many of the first of ``following``, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and falling id; the row after the last of a part comes with it, marked as a guest."""
    rows: list[tuple[int, int | None, str, bool]] = []

    def done(final: bool) -> pa.RecordBatch:
        ready = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and not a[3]]
        texts = [r[2] for r in rows]
        edits = [edited_text(a[2], b[2]) for a, b in ready]
        prints = fingerprints(texts + edits)
        own, edited = prints[: len(texts)], prints[len(texts) :]
        place = [i for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False)) if a[0] == b[0] and not a[3]]
        batch = pa.RecordBatch.from_arrays(
            [pa.array([a[1] for a, _ in ready], pa.int64()), pa.array([len(a[2]) for a, _ in ready], pa.int64()),
             pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits], pa.string()),
             pa.array([own[i] for i in place], pa.string()), pa.array(edited, pa.string()),
             pa.array([likeness(own[i], e) for i, e in zip(place, edited, strict=True)], pa.float64()),
             pa.array([likeness(own[i], own[i + 1]) for i in place], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
        del rows[: len(rows) if final else len(rows) - 1]
        return batch

    size = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_part", "doc_id", "text", "_guest")]
        for row in zip(*columns, strict=True):
            rows.append(row)
            size += len(row[2])
            if size >= BUFFER:
                yield done(False)
                size = len(rows[0][2])
    if rows:
        yield done(True)


EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next per row of ``docs``.  The edited text takes its end from the next row in
    falling doc_id (null last; rows of one id by falling text; after the last, the first).
    Null texts are empty; an empty text has an empty fingerprint; two empty ones are alike.
    A single row is its own next one.  An empty table gives an empty result.

    Rows are cut into parts by ranges of doc_id.  The first row of each part also goes to
    the part before it, so one shuffle brings every row together with its next one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # At most as many bounds as there are parts reach the driver.
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 10_000).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    part = F.lit(0)
    if bounds:
        # Falling ids: part 0 holds those above the highest bound; null ids stand in the last.
        table = F.lit(bounds).cast("array<bigint>")
        part = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(
            F.size(F.filter(table, lambda b: b >= F.col("doc_id")))).cast("int")
    cut = rows.withColumn("_part", part)
    ids = cut.groupBy("_part").agg(F.max("doc_id").alias("top")).orderBy("_part").collect()
    if not ids:
        return cut.select("doc_id").mapInArrow(lambda b: iter(()), EDITED)
    tops = [(ids[i]["_part"], ids[(i + 1) % len(ids)]["_part"], ids[(i + 1) % len(ids)]["top"]) for i in range(len(ids))]
    guests = spark.createDataFrame([(a, b) for a, b, _ in tops], "_host int, _from int")
    wanted = [t for _, _, t in tops if t is not None]
    first = cut.where(F.col("doc_id").isin(wanted) | (F.col("doc_id").isNull() if len(wanted) < len(tops) else F.lit(False)))
    known = first.groupBy("_part").agg(F.max(F.struct("doc_id", "text")).alias("_r"))
    sent = known.select(F.col("_r.doc_id").alias("doc_id"), F.col("_r.text").alias("text"), F.col("_part").alias("_p"))
    # One row per part.
    sent = sent.join(F.broadcast(guests), F.col("_p") == F.col("_from")).select("doc_id", "text", F.col("_host").alias("_part"), F.lit(True).alias("_guest"))
    everything = cut.withColumn("_guest", F.lit(False)).unionByName(sent)
    arranged = everything.repartition(parts, "_part").sortWithinPartitions("_part", "_guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    return arranged.select("_part", "doc_id", "text", "_guest").mapInArrow(_walk, EDITED)


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint per row of ``docs``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("string").alias("text"))
    return rows.mapInArrow(walk, "doc_id bigint, fingerprint string")


def octave_span(octave: int) -> tuple[int, int]:
    """Where an octave's digits begin in a fingerprint, and how many it has."""
    return sum(min(1 << i, SAMPLES) for i in range(octave)), min(1 << octave, SAMPLES)


@lru_cache(256)
def _places(octave: int, bands: int, digits: int) -> np.ndarray:
    """The digits of an octave that each band samples."""
    n = octave_span(octave)[1]
    return np.stack([np.random.default_rng([1000 + band, octave]).choice(n, digits, replace=False) for band in range(bands)])


def band_keys(fingerprint: str, bands: int, digits: int) -> np.ndarray:
    """Hashes of the bands of a fingerprint.

    They sample the last two octaves that it has in full, the octave below, which it shares with
    longer texts across a border, and what it has of the octave above.  Octaves of fewer than
    ``digits`` digits have no bands; the shortest fingerprints are hashed exactly besides.
    """
    data = np.frombuffer(fingerprint.encode(), np.uint8).astype(np.uint64)
    least = max(1, (min(digits, SHORT_DIGITS) - 1).bit_length())
    last = -1
    while sum(octave_span(last + 1)) <= len(data):
        last += 1
    found = []
    for octave in range(max(least, last - 2), last + 2):
        start = octave_span(octave)[0]
        size = digits if octave_span(octave)[1] == SAMPLES else min(digits, SHORT_DIGITS)
        places = _places(octave, bands, size)
        band = np.flatnonzero(places.max(1) + start < len(data))
        total = mix((band + octave * 4096 + 1).astype(np.uint64) * BASE)
        for i in range(size):
            total = mix(total * BASE + data[places[band, i] + start])
        found.append(total)
    if last <= least:
        # Too short for bands alone: the octaves below them together, and the whole.
        for whole in {fingerprint[: octave_span(least)[0]], fingerprint}:
            found.append(np.array([xxhash.xxh64_intdigest(whole)], np.uint64))
    return np.concatenate(found)


def near_matches(queries: DataFrame, prints: DataFrame, *, least: float = 0.8, bands: int = 24, digits: int = 5) -> DataFrame:
    """Rows of ``prints`` like the stated ``queries`` (both doc_id, fingerprint): query_id, doc_id, near.

    Bands of digits (:func:`band_keys`), keyed by octave, propose candidates between distinct
    fingerprints; likeness verifies them.  Empty fingerprints match nothing.
    """

    def distinct(df: DataFrame) -> DataFrame:
        some = df.where(F.length("fingerprint") > 0).select("fingerprint").distinct()
        return some.select(F.xxhash64("fingerprint").alias("name"), "fingerprint")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [band_keys(f, bands, digits) for f in batch.column("fingerprint").to_pylist()]
            if found:
                owner = pa.array(np.repeat(np.arange(len(found)), [len(k) for k in found]))
                yield pa.RecordBatch.from_arrays([batch.column("name").take(owner), pa.array(np.concatenate(found).view(np.int64))], names=["name", "band"])

    asked, known = kept(distinct(queries), "print-queries"), kept(distinct(prints), "print-names")
    left = asked.mapInArrow(keys, "name bigint, band bigint").withColumnRenamed("name", "qn")
    right = known.mapInArrow(keys, "name bigint, band bigint").withColumnRenamed("name", "dn")
    pairs = left.join(right, "band").select("qn", "dn").distinct()
    pairs = pairs.join(asked.select(F.col("name").alias("qn"), F.col("fingerprint").alias("q")), "qn")
    pairs = pairs.join(known.select(F.col("name").alias("dn"), F.col("fingerprint").alias("d")), "dn").select("q", "d")
    like = F.udf(likeness, "double", useArrow=True)
    good = kept(pairs.withColumn("near", like("q", "d")).where(F.col("near") >= least), "print-pairs")
    wanted = queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("q"))
    found = prints.select("doc_id", F.col("fingerprint").alias("d"))
    return wanted.join(good, "q").join(found, "d").where(F.col("query_id") != F.col("doc_id")).select("query_id", "doc_id", "near")
