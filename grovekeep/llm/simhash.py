"""Near duplicates by SimHash: meet-in-the-middle ball hashing.

A fingerprint has 64 bits, each the majority of that bit over the hashes of all
shingles of a text.  Two fingerprints at most three bits apart have a common
variant: a value that is reached from one by flipping at most half of the bits that
differ and from the other by flipping the rest.  So every distinct fingerprint
emits its variants, equal variants meet in a shuffle, and what meets is verified.

Half of three is no whole number, and the parity of a fingerprint says which side
takes the larger half.  At an odd distance one fingerprint has an even and the
other an odd number of ones: the even one flips none or one bit, the odd one one
or two.  Of three bits, two lie in the same half of the word, so two flips
stay within a half.  At distance two both have the same parity and flip one bit each.
That makes 65 variants of an even fingerprint and 1056 of an odd one.

No bucket of a variant makes all its pairs: whatever reached it by one flip at most is
within two bits of each other, and within three of what reached it by two.  The least of
the former is linked to all others, which connects the same fingerprints as all pairs do.
A bucket holds at most one fingerprint per variant, 1056, whatever the input is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import kept
from .common import whole_text
from .near_dups import components
from .textarrays import LOWER, mix, slices, text_bytes, word_spans

RADIUS = 3
SEED = 42
HALVES = [range(0, 32), range(32, 64)]
SINGLE = [1 << i for i in range(64)]
DOUBLE = [(1 << i) | (1 << j) for half in HALVES for i in half for j in half if i < j]
FLIPS = np.array([0, *SINGLE, *DOUBLE], np.uint64)
FLIPPED = np.bitwise_count(FLIPS).astype(np.uint8)
# Variants that are sorted at once by one task, fingerprints whose variants one task emits, and shingles hashed at once.
SLICE = 1 << 20
EMIT = 1 << 15
CHUNK = 1 << 18
# Longer spans are hashed one by one.
LONG_SPAN = 2048

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(lane: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _turned(lane + value * _P2, 31) * _P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span ``data[start:end]``, all spans at once."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    fours = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    at, s = starts.astype(np.int64), np.uint64(seed)
    with np.errstate(over="ignore"):
        out = np.full(len(at), s + _P5, np.uint64)
        wide = np.flatnonzero((ends - at >= 32) & (ends - at <= LONG_SPAN))
        if len(wide):
            lanes = [np.full(len(wide), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            here, stop, going = at[wide], ends[wide], np.arange(len(wide))
            while len(going):
                for i, lane in enumerate(lanes):
                    lane[going] = _round(lane[going], eights[here[going] + 8 * i])
                here[going] += 32
                going = going[stop[going] - here[going] >= 32]
            total = sum(_turned(lane, n) for lane, n in zip(lanes, (1, 7, 12, 18), strict=True))
            for lane in lanes:
                total = (total ^ _round(np.zeros_like(lane), lane)) * _P1 + _P4
            out[wide], at[wide] = total, here
        out += (ends - starts).astype(np.uint64)
        going = np.flatnonzero((ends - at >= 8) & (ends - starts <= LONG_SPAN))
        while len(going):
            out[going] = _turned(out[going] ^ _round(np.zeros(len(going), np.uint64), eights[at[going]]), 27) * _P1 + _P4
            at[going] += 8
            going = going[ends[going] - at[going] >= 8]
        going = np.flatnonzero((ends - at >= 4) & (ends - starts <= LONG_SPAN))
        out[going] = _turned(out[going] ^ (fours[at[going]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[going] += 4
        going = np.flatnonzero((ends > at) & (ends - starts <= LONG_SPAN))
        while len(going):
            out[going] = _turned(out[going] ^ (data[at[going]].astype(np.uint64) * _P5), 11) * _P1
            at[going] += 1
            going = going[ends[going] > at[going]]
        out = (out ^ (out >> np.uint64(33))) * _P2
        out = (out ^ (out >> np.uint64(29))) * _P3
        out ^= out >> np.uint64(32)
    for i in np.flatnonzero(ends - starts > LONG_SPAN):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


def _bit_counts(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> None:
    """Add to ``counts`` (texts by 64) how often each bit is set in the hashes of each text; owners ascend."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    # Eight counters to a word, of a byte each: no block has more than 255 hashes.
    blocks = np.union1d(first, np.arange(0, len(hashes), 255))
    seen = np.empty((len(blocks), 64), np.int64)
    for j in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & np.uint64(0x0101010101010101), blocks)
        seen[:, j::8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
    of = owner[blocks]
    start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    counts[of[start]] += np.add.reduceat(seen, start, axis=0)


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """The fingerprint of each text; a text without words has 0."""
    data, offsets = text_bytes(texts)
    starts, ends = word_spans(data, offsets)
    words = np.diff(np.searchsorted(starts, offsets)).astype(np.int64)
    if not len(starts):
        return np.zeros(len(texts), np.uint64)
    # All words in lower case, one space after each: a shingle is a span of that.
    stops = np.cumsum(ends - starts) + np.arange(len(starts))
    joined = np.full(int(stops[-1]) + 1, 32, np.uint8)
    in_word = np.ones(len(joined), bool)
    in_word[stops] = False
    outside = np.zeros(len(data) + 1, np.int8)
    outside[starts] += 1
    np.subtract.at(outside, ends, 1)
    joined[in_word] = LOWER[data[np.cumsum(outside[:-1]).astype(bool)]]
    begins = stops - (ends - starts)

    own = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    last_word = np.cumsum(words)
    first_shingle = np.cumsum(own) - own
    counts = np.zeros((len(texts), 64), np.int64)
    for low in range(0, int(own.sum()), CHUNK):
        number = np.arange(low, min(low + CHUNK, int(own.sum())))
        owner = np.searchsorted(first_shingle + own, number, "right")
        first = last_word[owner] - words[owner] + number - first_shingle[owner]
        last = np.minimum(first + shingle, last_word[owner]) - 1
        _bit_counts(xxh64_spans(joined, begins[first], stops[last]), owner, counts)
    bits = 2 * counts > own[:, None]
    return np.bitwise_or.reduce(np.where(bits, np.array(SINGLE, np.uint64), np.uint64(0)), axis=1)


def fingerprint_rows(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) per row of ``docs``."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = fingerprints(batch.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().cast("string").alias("text"))
    return rows.mapInArrow(prints, "doc_id bigint, fingerprint bigint")


def variants_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All variants of some fingerprints, each with the number of its flips in ``FLIPS``."""
    out, which = [], []
    odd = np.bitwise_count(prints) % 2 == 1
    for some, lo, hi in ((prints[~odd], 0, 1 + len(SINGLE)), (prints[odd], 1, len(FLIPS))):
        out.append((some[:, None] ^ FLIPS[None, lo:hi]).ravel())
        which.append(np.tile(np.arange(lo, hi, dtype=np.uint16), len(some)))
    return np.concatenate(out), np.concatenate(which)


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per run of ``values``."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _emitted(n_slices: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            variants, which = variants_of(batch.column("fingerprint").to_numpy().view(np.uint64))
            to = (mix(variants) % np.uint64(n_slices)).astype(np.uint16 if n_slices < 1 << 16 else np.int64)
            order = np.argsort(to, kind="stable")
            to, variants, which = to[order], variants[order], which[order]
            first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, int)
            bounds = np.append(first, len(to))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[first].astype(np.int64)), _packed(variants, bounds), _packed(which, bounds)], names=["slice", "variants", "which"])

    return emit


def meeting(variants: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Links (rows of two fingerprints) among what reached equal variants; each link is of ``RADIUS`` bits at most."""
    order = np.argsort(variants)
    variants, which = variants[order], which[order]
    same = variants[1:] == variants[:-1]
    met = np.zeros(len(variants), bool)
    met[1:] |= same
    met[:-1] |= same
    variants, which = variants[met], which[met]
    owner = variants ^ FLIPS[which]
    order = np.lexsort((owner, FLIPPED[which] == 2, variants))
    variants, owner, twice = variants[order], owner[order], FLIPPED[which[order]] == 2
    first = np.flatnonzero(np.concatenate(([True], variants[1:] != variants[:-1]))) if len(variants) else np.zeros(0, int)
    sizes = np.diff(np.append(first, len(variants)))
    centre = np.repeat(owner[first], sizes)
    # Where all have flipped two bits, nothing says that they are near each other.
    apart = np.bitwise_count(centre ^ owner)
    good = ~np.repeat(twice[first], sizes) & (centre != owner) & (apart <= RADIUS)
    return np.unique(np.stack([centre[good], owner[good]], 1), axis=0)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice; one slice is held at a time."""

    def links(variants: list[bytes], which: list[bytes]) -> pa.RecordBatch:
        found = meeting(np.frombuffer(b"".join(variants), np.uint64), np.frombuffer(b"".join(which), np.uint16)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["a", "b"])

    now, variants, which = None, [], []
    for batch in batches:
        for part, v, w in zip(batch.column("slice").to_pylist(), batch.column("variants"), batch.column("which"), strict=True):
            if part != now and variants:
                yield links(variants, which)
                variants, which = [], []
            now = part
            variants.append(v.as_py())
            which.append(w.as_py())
    if variants:
        yield links(variants, which)


def near_links(nodes: DataFrame) -> DataFrame:
    """a and b: links of at most ``RADIUS`` differing bits between the distinct fingerprints ``nodes`` (fingerprint).

    Not all of them, but as many as connect what all of them would connect.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = nodes.count()
    n_slices = max(4 * parts, math.ceil(count * (1 + 2 * len(SINGLE) + len(DOUBLE)) / 2 / SLICE))
    # A fingerprint makes some 560 variants: the tasks that emit are dealt by that, not by the few bytes they read.
    dealt = nodes.select("fingerprint").repartition(max(parts, math.ceil(count / EMIT)), "fingerprint")
    emitted = dealt.mapInArrow(_emitted(n_slices), "slice bigint, variants binary, which binary")
    met = emitted.repartition("slice").sortWithinPartitions("slice").mapInArrow(_linked, "a bigint, b bigint")
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_groups(docs: DataFrame, *, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id per row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z in lower case; shingles are
    runs of ``shingle`` words, repeats included, joined by a space; with fewer words the
    whole sequence is one.  Each shingle counts by its XXH64 (UTF-8, seed 42), and a bit is set where
    it is in over half of them.  A null, empty or blank text has fingerprint zero and is linked like any
    other.  Fingerprints at most three bits apart are linked; a component has the smallest doc_id of the
    rows connected (null only where all its ids are).  Repeated rows give repeated results, an empty
    table gives an empty one, and further columns are not read.
    """
    prints = kept(fingerprint_rows(docs, shingle), "simhash-prints")
    # Equal fingerprints are combined before the shuffle: a group of copies is one node.
    nodes = kept(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    links = kept(near_links(nodes), "simhash-links")
    roots = components(links, "simhash").withColumnsRenamed({"node": "_node", "root": "_root"})
    rooted = nodes.join(roots, F.col("fingerprint") == F.col("_node"))
    least = rooted.groupBy("_root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("_root", "_of")
    linked = rooted.join(least, F.col("_root") == F.col("_of")).select("fingerprint", "component_id")
    alone = nodes.join(roots, F.col("fingerprint") == F.col("_node"), "left_anti").select("fingerprint", F.col("first_id").alias("component_id"))
    of_print = linked.unionByName(alone).withColumnRenamed("fingerprint", "_print")
    joined = prints.join(of_print, F.col("fingerprint") == F.col("_print"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
