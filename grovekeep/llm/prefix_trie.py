"""Prefix trie of conversations by truncation peeling.

A node is a sequence of first turns.  Peeling starts with the conversations that have the most
stops on their way: sequences where a conversation ends or others branch off.  At each level
the conversations that end there join the nodes that have survived from below; equal sequences are merged,
which discovers the nodes of the level and adds up what their subtrees hold at the same time; then every
node loses its last turns down to the stop before and goes on as one child of that sequence.  Turns
between two stops make nodes with one child each, whose figures follow from the node
below; they are stripped at once, so a long conversation that shares nothing costs no rounds of its own.
There are as many rounds as one path has stops.

Sequences are compared by keys: the running xor of two 64-bit hashes of each turn with its place.
Conversations of the same sequence are one row from the start.  A row carries ``SPAN`` of the
stops before it only, and gets the next ones when they are used up.  Turns are placed and summed up over
range partitions, so a conversation may have any number of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import kept, new_path
from .common import sums_before

SPAN = 32
KEPT = "conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NODE = f"{KEPT}, depth bigint, parent_conv_id bigint"
# Ids of an ending group that are written out as one piece of text.
PIECE = 4096


def running_xor(rows: DataFrame, group: str, order: str, values: list[str], label: str) -> DataFrame:
    """``rows`` with ``upto_<value>``: the xor of a value over the rows of the group up to this one.

    Rows are range-partitioned by group and order; only groups that reach over several
    partitions, at most one more than there are partitions, need what lies in earlier ones.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = kept(rows.repartitionByRange(parts, group, order).withColumn("_part", F.spark_partition_id()), label)
    sums = cut.groupBy(group, "_part").agg(*[F.bit_xor(v).alias(f"_sum_{v}") for v in values])
    several = sums.groupBy(group).agg(F.count(F.lit(1)).alias("_parts")).where(F.col("_parts") > 1).select(F.col(group).alias("_several"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.join(several, F.col(group) == F.col("_several")).select(
        F.col(group).alias("_of"), F.col("_part").alias("_in"), *[F.coalesce(F.bit_xor(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_offset_{v}") for v in values])
    local = Window.partitionBy("_part", group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = cut.withColumns({f"_local_{v}": F.bit_xor(v).over(local) for v in values})
    # At most two rows per partition: small whatever the table's size.
    joined = found.join(F.broadcast(offsets), (F.col(group) == F.col("_of")) & (F.col("_part") == F.col("_in")), "left")
    return joined.select(*rows.columns, *[F.col(f"_local_{v}").bitwiseXOR(F.coalesce(F.col(f"_offset_{v}"), F.lit(0))).alias(f"upto_{v}") for v in values])


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv, place (from 1), h1 and h2 (hashes of role and text) and bytes per turn, ordered by turn (null first)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    narrow = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), both.alias("same"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("_one"))
    order = kept(sums_before(narrow, ["conv", "turn", "same"], ["_one"], "trie-order"), "trie-places")
    starts = order.groupBy("conv").agg(F.min("before__one").alias("_start")).withColumnRenamed("conv", "_conv")
    joined = order.join(starts, F.col("conv") == F.col("_conv"))
    return joined.select("conv", (F.col("before__one") - F.col("_start") + 1).alias("place"), "same", "bytes")


def graft_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % 9


def rebuilt_turns(turns: DataFrame, *, heads: int = 5, length=graft_length, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv, depth, same, bytes), and all conversations (conv).

    Conversation c gets the first h turns of c - c % ``heads``, h = ``length(c)`` being ``longest`` at
    most, and then its own turns after its first h.
    """
    placed = kept(placed_turns(turns), "trie-turns")
    convs = kept(placed.select("conv").distinct().withColumns({"head": F.col("conv") - F.col("conv") % heads, "h": length(F.col("conv"))}), "trie-convs")
    first = placed.where(F.col("place") <= longest).select(F.col("conv").alias("_head"), "place", "same", "bytes")
    grafted = convs.join(first, (F.col("head") == F.col("_head")) & (F.col("place") <= F.col("h"))).select("conv", F.col("place").alias("depth"), "same", "bytes")
    sizes = first.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    shifts = convs.join(sizes, F.col("head") == F.col("_head"), "left").select(
        F.col("conv").alias("_conv"), "h", (F.least("h", F.coalesce("_n", F.lit(0))) - F.col("h")).alias("_shift"))
    own = placed.join(shifts, F.col("conv") == F.col("_conv")).where(F.col("place") > F.col("h"))
    own = own.select("conv", (F.col("place") + F.col("_shift")).alias("depth"), "same", "bytes")
    return grafted.unionByName(own), convs.select("conv")


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by depth, key and number; one group's text passes through one hash, never held whole."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2", "ends_sha256"), (*now, state.hexdigest()), strict=True))])

    for batch in batches:
        for depth, k1, k2, ids in zip(*[batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids")], strict=True):
            if (depth, k1, k2) != now:
                if now is not None:
                    yield row()
                now, state = (depth, k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if now is not None:
        yield row()


def ending_groups(finals: DataFrame) -> DataFrame:
    """depth, k1, k2, n_convs, conv_id (the smallest) and ends_sha256 per distinct rebuilt conversation of ``finals`` (conv, depth, k1, k2)."""
    key = ["depth", "k1", "k2"]
    # The ids of a group in order, in pieces: a group may hold any part of all conversations.
    order = kept(sums_before(finals.withColumn("_one", F.lit(1).cast("bigint")), [*key, "conv"], ["_one"], "trie-ends"), "trie-ranked")
    groups = order.groupBy(*key).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"))
    pieces = order.groupBy(*key, F.floor(F.col("before__one") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list("conv")).alias("_ids"))
    pieces = pieces.select(*key, "piece", F.array_join(F.col("_ids").cast("array<string>"), ",").alias("ids"))
    hashed = pieces.repartition(*key).sortWithinPartitions(*key, "piece").mapInArrow(_hash_pieces, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")
    hashed = hashed.withColumnsRenamed({c: f"_{c}" for c in key})
    match = (F.col("depth") == F.col("_depth")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    return groups.join(hashed, match).select(*key, "n_convs", "conv_id", "ends_sha256")


def prefix_trie(turns: DataFrame, **rebuild) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text); see :func:`rebuilt_turns`.

    Per node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, members
    but one times bytes of the last text) and ends_sha256 (the ids of the conversations that end here,
    ascending, joined by commas; that of the empty string where none does).

    Null roles and texts are empty ones; turns of the same number, or without one, stand in the
    order of a digest of role and text, so repeated rows are turns of their own; rows without conv_id
    belong to no conversation and are left out; a rebuilt conversation without turns ends at the root; an
    empty table gives an empty result; further columns are not read.
    """
    spark = turns.sparkSession
    rebuilt, convs = rebuilt_turns(turns, **rebuild)
    convs = kept(convs, "trie-all")
    hashed = rebuilt.select("conv", F.col("depth").cast("bigint").alias("depth"), "bytes", F.xxhash64("depth", "same").alias("h1"), F.xxhash64("same", "depth", F.lit(1)).alias("h2"))
    keyed = running_xor(hashed, "conv", "depth", ["h1", "h2"], "trie-hashed").select(
        "conv", "depth", "bytes", F.col("upto_h1").alias("k1"), F.col("upto_h2").alias("k2"),
        F.col("upto_h1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("upto_h2").bitwiseXOR(F.col("h2")).alias("p2"))
    keyed = kept(keyed, "trie-keys")
    ends = keyed.groupBy("conv").agg(F.max(F.struct("depth", "k1", "k2")).alias("_end")).withColumnRenamed("conv", "_conv")
    zero = F.lit(0).cast("bigint")
    finals = convs.join(ends, F.col("conv") == F.col("_conv"), "left").select("conv", *[F.coalesce(f"_end.{c}", zero).alias(c) for c in ("depth", "k1", "k2")])
    groups = kept(ending_groups(finals), "trie-groups")

    # One conversation of each group stands for it.  Where as many sequences go on to one child as have come, nothing stops.
    chosen = groups.select(F.col("conv_id").alias("_rep"))
    turned = kept(keyed.join(chosen, F.col("conv") == F.col("_rep")).drop("_rep"), "trie-chosen")
    counts = turned.groupBy("depth", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    counts = kept(counts, "trie-counts")
    single = counts.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n")
    stops = counts.join(single, ["depth", "k1", "k2", "n"], "left_anti").select(
        F.col("depth").alias("_depth"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.lit(1).cast("bigint").alias("_stop"))
    on_stop = (F.col("depth") == F.col("_depth")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    marked = turned.join(stops, on_stop, "left").select("conv", "depth", "k1", "k2", "bytes", F.coalesce("_stop", zero).alias("stop"))
    summed = kept(sums_before(marked, ["conv", "depth"], ["stop", "bytes"], "trie-marked"), "trie-summed")
    begun = summed.groupBy("conv").agg(F.min("before_stop").alias("_stops"), F.min("before_bytes").alias("_bytes")).withColumnRenamed("conv", "_conv")
    # ``level``: the first stop at or after the turn, counted from the start; ``before``: bytes of the turns before.
    levels = kept(summed.join(begun, F.col("conv") == F.col("_conv")).select(
        "conv", "depth", "k1", "k2", "bytes", "stop", (F.col("before_stop") - F.col("_stops") + 1).alias("level"),
        (F.col("before_bytes") - F.col("_bytes")).alias("before")), "trie-levels")
    stopped = levels.where(F.col("stop") == 1).withColumnRenamed("conv", "_rep")
    paths = stopped.groupBy("_rep", F.floor((F.col("level") - 1) / SPAN).alias("_span"))
    paths = kept(paths.agg(F.sort_array(F.collect_list(F.struct("level", "depth", "k1", "k2", "before", "bytes"))).alias("path")), "trie-paths")
    ends_at = stopped.groupBy("_rep").agg(F.max("level").alias("_level"))
    ending = groups.join(ends_at, F.col("conv_id") == F.col("_rep"), "left").select(
        F.coalesce("_level", zero).alias("level"), "depth", "k1", "k2", "conv_id", "n_convs", "ends_sha256")
    ending = kept(ending, "trie-ending")

    def with_path(rows: DataFrame, level: int) -> DataFrame:
        """``rows`` of a level with their stops from there on, the last one being their own."""
        own = paths.where(F.col("_span") == (level - 1) // SPAN)
        return rows.join(own, F.col("conv_id") == F.col("_rep")).drop("_rep", "_span")

    folder, survivors = new_path(spark, "trie-nodes"), None
    highest = ending.agg(F.max("level").alias("level")).first()["level"]
    if highest is None:
        return spark.createDataFrame([], NODE)
    for level in range(highest, -1, -1):
        rows = ending.where(F.col("level") == level).select("depth", "k1", "k2", "conv_id", "n_convs", zero.alias("child"), zero.alias("leaves"), zero.alias("saved"), "ends_sha256")
        rows = with_path(rows, level) if level else rows.withColumn("path", F.lit(None).cast(paths.schema["path"].dataType))
        if survivors is not None:
            rows = rows.unionByName(survivors)
        merged = rows.groupBy("depth", "k1", "k2").agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"),
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends_sha256").alias("ends_sha256"), F.first("path").alias("path"))
        if level > 1 and (level - 1) % SPAN == 0:
            # The stops before are in the next row of them.
            earlier = with_path(merged.select("depth", "k1", "k2", "conv_id"), level - 1).select(
                F.col("depth").alias("_d"), F.col("k1").alias("_a"), F.col("k2").alias("_b"), F.col("path").alias("_path"))
            merged = merged.join(earlier, (F.col("depth") == F.col("_d")) & (F.col("k1") == F.col("_a")) & (F.col("k2") == F.col("_b")))
            merged = merged.withColumn("path", F.concat("_path", F.slice("path", -1, 1))).drop("_d", "_a", "_b", "_path")
        own, up = F.try_element_at("path", F.lit(-1)), F.try_element_at("path", F.lit(-2))
        known = lambda c: F.coalesce(c, zero)
        nodes = merged.select(
            F.lit(level).cast("bigint").alias("level"), "depth", "k1", "k2", "conv_id", "n_convs", "n_children", F.greatest("leaves", F.lit(1)).alias("n_leaves"),
            (F.col("saved") + (F.col("n_convs") - 1) * known(own["bytes"])).alias("saved_tokens"), "ends_sha256",
            known(own["before"]).alias("before"), known(up["depth"]).alias("up_depth"), known(up["k1"]).alias("up_k1"), known(up["k2"]).alias("up_k2"),
            known(up["before"] + up["bytes"]).alias("up_bytes"), F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("path"))
        nodes.write.parquet(f"{folder}/of={level}")
        # The last turns go; what is left is a child of the sequence up to the stop before.
        between = (F.col("n_convs") - 1) * (F.col("before") - F.col("up_bytes"))
        survivors = spark.read.schema(nodes.schema).parquet(f"{folder}/of={level}").select(
            F.col("up_depth").alias("depth"), F.col("up_k1").alias("k1"), F.col("up_k2").alias("k2"), "conv_id", "n_convs", F.lit(1).cast("bigint").alias("child"),
            F.col("n_leaves").alias("leaves"), (F.col("saved_tokens") + between).alias("saved"), F.lit(None).cast("string").alias("ends_sha256"), "path")
    nodes = spark.read.schema(nodes.drop("path").schema).parquet(*[f"{folder}/of={level}" for level in range(highest + 1)])
    above = nodes.select(F.col("depth").alias("_depth"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("conv_id").alias("up_conv_id"))
    above = nodes.join(above, (F.col("up_depth") == F.col("_depth")) & (F.col("up_k1") == F.col("_k1")) & (F.col("up_k2") == F.col("_k2")))
    # Every turn of a stop's smallest member since the stop before is a node of the same members.
    below = above.where(F.col("level") > 0).select(
        F.col("conv_id").alias("_of"), F.col("level").alias("_level"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
        F.col("before").alias("_before"), "up_depth", "up_conv_id")
    found = levels.join(below, (F.col("conv") == F.col("_of")) & (F.col("level") == F.col("_level")))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    here = F.col("stop") == 1
    found = found.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("up_depth") + 1, F.col("up_conv_id")).otherwise(F.col("conv")).alias("parent_conv_id"),
        "n_convs", F.when(here, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * (F.col("_before") - F.col("before"))).alias("saved_tokens"),
        F.when(here, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"))
    root = nodes.where(F.col("level") == 0).select(
        "conv_id", "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
    return root.unionByName(found)
