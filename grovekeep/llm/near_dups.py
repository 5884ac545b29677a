"""Near duplicates by b-bit MinHash.

Each text's distinct shingles give 128 minima.  Bands of four minima, in full,
propose candidates; the lowest four bits of every minimum are packed into eight
integers, from which the similarity of a candidate pair is estimated by counting
equal groups of bits, corrected for groups that are equal by chance.  Pairs that
may reach the threshold are confirmed on the full sets.

A band's bucket is not turned into all pairs.  First every text is compared with one
pivot of each of its buckets, twice, which connects copies of a common original.
Only buckets that still hold texts of different components go on: their texts get a
longer signature, and tasks compare blocks of a bucket with each other, passing
over pairs that are connected already, pairs met in an earlier band, pairs whose
set sizes rule the threshold out, pairs estimated too low, and pairs whose sets,
with 32 bits a shingle, fall short.  What is left is confirmed on the words.  So every proposed pair is either judged or connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Rounds, Work, kept
from .common import text_key, unused, whole_text
from .textarrays import mix, shingle_hashes, slices, text_bytes, word_hashes

MINIMA, ROWS, BITS = 128, 4, 4
BANDS = MINIMA // ROWS
PER_LONG = 64 // BITS
# An estimate this far below the threshold rules a pair out: five standard deviations,
# 0.037 for 128 minima of four bits and 0.0133 for 2048 minima of one bit.
MARGIN = 0.185
LONG_MINIMA = 2048
LONG_MARGIN = 0.067
BLOCK = 2048
STARS = 2

_factors = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_shifts = mix(np.arange(1001, 1001 + MINIMA, dtype=np.uint64)).astype(np.uint32)

SIGNATURES = (
    "doc_id bigint, text_key bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, bits array<bigint>"
)


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text and how many there are."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.bincount(o[new], minlength=len(counts))


def _signatures(size: int):
    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words, counts = word_hashes(*text_bytes(batch.column("text")))
                sets, sizes = _distinct(*shingle_hashes(words, counts, size))
                n, filled = len(sizes), np.flatnonzero(sizes)
                sum_a, sum_b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                bands, bits = np.zeros((n, BANDS), np.uint64), np.zeros((n, MINIMA // PER_LONG), np.uint64)
                if len(filled):
                    starts = np.concatenate(([0], np.cumsum(sizes[filled])))[:-1]
                    sum_a[filled] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    sum_b[filled] = np.add.reduceat(mix(sets ^ np.uint64(0x14057B7EF767814F)), starts)
                    short = (sets >> np.uint64(32)).astype(np.uint32)
                    for i in range(MINIMA):
                        least = np.minimum.reduceat(short * _factors[i] + _shifts[i], starts).astype(np.uint64)
                        band = i // ROWS
                        bands[filled, band] = mix(bands[filled, band] + least + np.uint64(band + 1))
                        group = (least & np.uint64((1 << BITS) - 1)) << np.uint64(BITS * (i % PER_LONG))
                        bits[filled, i // PER_LONG] |= group
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes.astype(np.int64)),
                     pa.array(sum_a.view(np.int64)), pa.array(sum_b.view(np.int64)),
                     pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array(list(bits.view(np.int64)), pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "bits"],
                )

    return signatures


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """Set size, 128-bit name of the set, band hashes and packed bits per row; all zero for texts without words."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), whole_text().cast("string").alias("text"))
    return rows.mapInArrow(_signatures(shingle), SIGNATURES)


def estimated(left: Column, right: Column) -> Column:
    """Similarity from two packed signatures: the share of equal groups of bits, less what chance makes equal."""
    ones = F.lit(int("1" * PER_LONG, 16))
    equal = F.lit(0)
    for i in range(MINIMA // PER_LONG):
        x = left[i].bitwiseXOR(right[i])
        for shift in (2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        equal = equal + PER_LONG - F.bit_count(x.bitwiseAND(ones))
    chance = 2.0**-BITS
    return (equal / MINIMA - chance) / (1 - chance)


def _confirmed(shingle: int, percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with 100 * intersection >= percent * union, judged on the words themselves."""
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sets, owners = [], []
                for name in ("x", "y"):
                    words, counts = word_hashes(*text_bytes(batch.column(name)))
                    found, sizes = _distinct(*shingle_hashes(words, counts, shingle))
                    sets.append(found)
                    owners.append(np.repeat(np.arange(batch.num_rows), sizes))
                values, owner = np.concatenate(sets), np.concatenate(owners)
                order = np.lexsort((values, owner))
                v, o = values[order], owner[order]
                twice = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
                both = np.bincount(o[1:][twice], minlength=batch.num_rows)
                union = np.bincount(o, minlength=batch.num_rows) - both
                good = pa.array(100 * both >= percent * union)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(good)

    return confirm


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_confirmed(shingle, percent), "a bigint, b bigint")


def _long_signatures(shingle: int):
    factors = mix(np.arange(5001, 5001 + LONG_MINIMA, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    shifts = mix(np.arange(9001, 9001 + LONG_MINIMA, dtype=np.uint64)).astype(np.uint32)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lowest bit of each of many minima, packed, and the set itself with 32 bits a member."""
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                words, counts = word_hashes(*text_bytes(batch.column("text")))
                sets, sizes = _distinct(*shingle_hashes(words, counts, shingle))
                short = (sets >> np.uint64(32)).astype(np.uint32)
                starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                bits = np.zeros((LONG_MINIMA, len(sizes)), np.uint8)
                for i in range(LONG_MINIMA):
                    # The top bits decide which is least; a bit mixed from all of them is kept.
                    least = np.minimum.reduceat(short * factors[i] + shifts[i], starts)
                    bits[i] = (mix(least.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(bits.T, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array(sizes.astype(np.int64)), pa.array([r.tobytes() for r in packed], pa.binary()),
                     pa.array([np.unique(short[x : x + n]).tobytes() for x, n in zip(starts, sizes, strict=True)], pa.binary())],
                    names=["node", "n", "sketch", "members"],
                )

    return signed


def _compared(percent: int):
    least = percent / 100 - LONG_MARGIN

    def reachable(left: bytes, right: bytes, n_left: int, n_right: int) -> bool:
        """Whether two sets, of which 32 bits a member are known, may reach the threshold: never false for those that do."""
        a, b = np.frombuffer(left, np.uint32), np.frombuffer(right, np.uint32)
        merged = np.sort(np.concatenate([a, b]))
        both = int((merged[1:] == merged[:-1]).sum()) + int(n_left - len(a))
        return 100 * both >= percent * (n_left + n_right - both)

    def block_pairs(band: int, side: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, sketch: np.ndarray, bands: np.ndarray, sets: list[bytes]) -> list[np.ndarray]:
        """Candidates of one block, or of two (side 0 against side 1)."""
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        out, step = [], max(1, (1 << 18) // max(len(right), 1))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            a, b = np.nonzero((root[i][:, None] != root[right][None, :]) & (100 * np.minimum(n[i][:, None], n[right][None, :]) >= percent * np.maximum(n[i][:, None], n[right][None, :])))
            a, b = i[a], right[b]
            if right is left:
                a, b = a[a < b], b[a < b]
            for start in range(0, len(a), 1 << 14):
                x, y = a[start : start + (1 << 14)], b[start : start + (1 << 14)]
                unequal = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
                good = 1 - 2 * unequal / LONG_MINIMA >= least
                x, y = x[good], y[good]
                first = (bands[x] == bands[y]).argmax(axis=1) == band
                x, y = x[first], y[first]
                can = np.array([reachable(sets[i], sets[j], n[i], n[j]) for i, j in zip(x, y, strict=True)], bool)
                x, y = node[x[can]], node[y[can]]
                out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and pair of blocks; a group may reach over batches."""
        waiting: pa.Table | None = None

        def judged(table: pa.Table) -> pa.RecordBatch:
            bucket, one, two = (table.column(c).to_numpy() for c in ("bucket", "one", "two"))
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            band, side, node, root, n = (table.column(c).to_numpy() for c in ("band", "side", "node", "root", "n"))
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            sets = table.column("members").to_pylist()
            found = [np.zeros((0, 2), np.int64)]
            for s, e in zip([0, *cuts], [*cuts, len(node)], strict=True):
                found += block_pairs(int(band[s]), side[s:e], node[s:e], root[s:e], n[s:e], sketch[s:e], bands[s:e], sets[s:e])
            pairs = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            if waiting.num_rows == 0:
                continue
            last = [waiting.column(c)[waiting.num_rows - 1].as_py() for c in ("bucket", "one", "two")]
            same = np.ones(waiting.num_rows, bool)
            for c, v in zip(("bucket", "one", "two"), last, strict=True):
                same &= waiting.column(c).to_numpy() == v
            done = waiting.num_rows - int(same.sum())
            if done:
                yield judged(waiting.slice(0, done))
                waiting = waiting.slice(done)
        if waiting is not None and waiting.num_rows:
            yield judged(waiting)

    return compare


def candidate_pairs(members: DataFrame, detail: DataFrame, percent: int) -> DataFrame:
    """Pairs of different roots that share a bucket and may reach the threshold.

    ``members``: bucket, band, node, root; ``detail``: node, n, sketch, bands, members.  A bucket of
    more than ``BLOCK`` texts is cut into blocks, and each pair of blocks is a group of its own.
    """
    counts = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    rows = members.join(counts, "bucket").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("bucket", F.least("_own", "_other").alias("one"), F.greatest("_own", "_other").alias("two"),
                       (F.col("_own") > F.col("_other")).cast("int").alias("side"), "band", "node", "root")
    rows = rows.join(detail, "node").select("bucket", "one", "two", "side", "band", "node", "root", "n", "sketch", "bands", "members")
    rows = rows.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    return rows.mapInArrow(_compared(percent), "a bigint, b bigint")


def components(edges: DataFrame, label: str) -> DataFrame:
    """node and root (the smallest node it is connected to) for all nodes of ``edges`` (a, b).

    Roots are hooked onto smaller neighbours' roots and paths are halved, until
    nothing changes; each round is a written table.
    """
    spark = edges.sparkSession
    edges = kept(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    rounds = Rounds(spark, f"{label}-roots")
    roots, _ = rounds.write(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        of_a, of_b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        seen = edges.join(of_a, "a").join(of_b, "b").where(F.col("ra") != F.col("rb"))
        offers = seen.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("rb").alias("offer")),
                                               F.struct(F.col("ra").alias("node"), F.col("rb").alias("offer")))).alias("_o")).select("_o.*")
        least = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = roots.join(least, "node", "left").select("node", "root", F.least("root", "offer").alias("next"))
        up = hooked.select(F.col("node").alias("next"), F.col("next").alias("above"))
        moved = hooked.join(up, "next", "left").select("node", F.coalesce("above", "next").alias("root"), (F.coalesce("above", "next") != F.col("root")).alias("moved"))
        roots, seen = rounds.write(moved, moved=F.coalesce(F.sum(F.col("moved").cast("int")), F.lit(0)))
        roots = roots.select("node", "root")
        if not seen["moved"]:
            return roots


def near_groups(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id per row of ``docs``.

    Words are runs of characters other than ASCII white space, A-Z in lower case.  A set
    holds the distinct runs of ``shingle`` words; with fewer words, the whole sequence.
    Rows whose sets meet 100 * intersection >= percent * union are linked, and a component
    has the smallest doc_id of the rows connected.  Texts that are null or without words have an
    empty set, no link and their own id.  Equal texts share a component; repeated rows give
    repeated results; an empty table gives an empty one; further columns are not read.
    """
    signed = kept(signatures(docs, shingle), "near-signatures")
    sets = signed.where(F.col("n_shingles") > 0)
    # One node per distinct set.  Identical sets are combined before the shuffle.
    named = sets.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
    )
    nodes = kept(named.select(
        F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "first_id",
        F.col("row.doc_id").alias("doc_id"), F.col("row.text_key").alias("text_key"), "bands", "bits"), "near-nodes")
    with Work(docs.sparkSession) as work:
        placed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
        shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        members = work.kept(placed.join(shared.select("bucket"), "bucket").withColumn("root", F.col("node")), "near-members")

        # Whole texts of the nodes that have any candidate, once.
        wanted = members.select("node").distinct().join(nodes.select("node", "doc_id", "text_key", "bits"), "node")
        wanted = wanted.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), whole_text().cast("string").alias("text"))
        texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
        texts = texts.select("node", "bits", "text")
        # Repeated rows would repeat their node here.
        alone = sets.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).isEmpty()
        texts = work.kept(texts if alone else texts.dropDuplicates(["node"]), "near-texts")

        # Every text against one pivot of each of its buckets, which connects copies of
        # one original; then again with other pivots where components are still apart.
        bits, links, roots = texts.select("node", "bits"), None, None
        for turn in range(STARS):
            pivots = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("pivot"), F.col("root").alias("of"))).alias("_p"))
            pivots = pivots.select("bucket", "_p.pivot", "_p.of")
            pairs = members.join(pivots, "bucket").where(F.col("root") != F.col("of"))
            pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
            judged = pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("_x")), "a").join(
                bits.select(F.col("node").alias("b"), F.col("bits").alias("_y")), "b")
            judged = judged.where(estimated(F.col("_x"), F.col("_y")) >= percent / 100 - MARGIN).select("a", "b")
            found = work.kept(confirmed(judged, texts, shingle, percent), "near-links")
            links = found if links is None else links.union(found)
            roots = components(links, "near")
            members = work.kept(members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")
            mixed = members.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where(F.col("_lo") != F.col("_hi"))
            members = work.kept(members.join(mixed.select("bucket"), "bucket"), "near-open")

        # Whatever is left in buckets of several components, block by block.
        wanted = members.select("node").distinct()
        detail = texts.select("node", "text").join(wanted, "node").mapInArrow(_long_signatures(shingle), "node bigint, n bigint, sketch binary, members binary")
        detail = work.kept(detail.join(nodes.select("node", "bands"), "node"), "near-detail")
        pairs = work.kept(candidate_pairs(members, detail, percent), "near-pairs")
        more = work.kept(confirmed(pairs, texts, shingle, percent), "near-links")
        if not more.isEmpty():
            roots = components(links.union(more), "near")

    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_set = nodes.join(least, "root").select(F.col("set_a").alias("_a"), F.col("set_b").alias("_b"), F.col("component_id").alias("_c"))
    joined = signed.join(of_set, (F.col("set_a") == F.col("_a")) & (F.col("set_b") == F.col("_b")) & (F.col("n_shingles") > 0), "left")
    return joined.select("doc_id", "text_key", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that carry their component's id, one per component and text; all rows with an empty set but repeats stay."""
    times, of, key, here, key_here = unused(docs, "times", "id", "key", "id_here", "key_here")
    chosen = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(of), F.col("text_key").alias(key))
    chosen = chosen.agg(F.count(F.lit(1)).alias(times))
    rows = docs.withColumns({here: F.col("doc_id").cast("bigint"), key_here: text_key()})
    joined = rows.join(chosen, F.col(here).eqNullSafe(F.col(of)) & (F.col(key_here) == F.col(key)))
    once = joined.where(F.col(times) == 1)
    more = joined.where(F.col(times) > 1).dropDuplicates([here, key_here])
    return once.unionByName(more).select(*[f"`{c}`" for c in docs.columns])
