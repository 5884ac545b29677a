"""Resharding by minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones, a flow of
least cost says how many bytes go from each old shard to each new one; a byte
that stays costs nothing.  The rows of an old shard, in a fixed order, are then
cut at the running totals of its flows, and only files of shards that give or
take rows are written anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Work, kept, new_path
from .common import sums_before, unused, whole_text


def cheapest_flow(
    sizes: list[int], capacities: list[int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)
) -> list[list[int]]:
    """Bytes to send from old shard i to new shard j, as a matrix; the capacities have to hold all sizes.

    Successive shortest paths with potentials over the shards, whose number is small.
    What can stay stays first, at no cost; the other moves follow by least cost.
    """
    if sum(sizes) > sum(capacities):
        raise ValueError("the new shards cannot hold the old ones")
    n, m = len(sizes), len(capacities)
    flow = [[0] * m for _ in range(n)]
    left, room = list(sizes), list(capacities)
    for i in range(min(n, m)):
        if cost(i, i) == 0:
            flow[i][i] = min(left[i], room[i])
            left[i] -= flow[i][i]
            room[i] -= flow[i][i]
    costs = [[cost(i, j) for j in range(m)] for i in range(n)]
    potential = [0] * (n + m)
    for source in range(n):
        while left[source]:
            # Dijkstra over reduced costs: old shards are 0..n-1, new ones n..n+m-1.
            far, back = {source: 0}, {}
            heap, done = [(0, source)], set()
            while heap:
                d, u = heapq.heappop(heap)
                if u in done:
                    continue
                done.add(u)
                steps = (
                    ((n + j, costs[u][j]) for j in range(m)) if u < n
                    else ((i, -costs[i][u - n]) for i in range(n) if flow[i][u - n])
                )
                for v, c in steps:
                    to = d + c + potential[u] - potential[v]
                    if v not in far or to < far[v]:
                        far[v], back[v] = to, u
                        heapq.heappush(heap, (to, v))
            end = min((v for v in far if v >= n and room[v - n]), key=lambda v: (far[v] + potential[v], v))
            for v, d in far.items():
                potential[v] += min(d, far[end])
            path, v = [end], end
            while v != source:
                v = back[v]
                path.append(v)
            path.reverse()
            amount = min(left[source], room[end - n])
            for u, v in zip(path, path[1:], strict=False):
                if u >= n:
                    amount = min(amount, flow[v][u - n])
            for u, v in zip(path, path[1:], strict=False):
                if u < n:
                    flow[u][v - n] += amount
                else:
                    flow[v][u - n] -= amount
            left[source] -= amount
            room[end - n] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [(total + shards - 1 - j) // shards for j in range(shards)]


def row_size(name: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(name)), F.lit(0)) + 1).cast("bigint")


def text_crc32(name: str = "text") -> Column:
    return F.crc32(whole_text(name))


def row_name(df: DataFrame) -> Column:
    """A string that rows share only if they are alike in all columns: id, checksum and size of the text, and a hash of the rest."""
    plain = [F.to_json(F.struct(c)) if "map<" in t or t == "variant" else F.col(f"`{c}`") for c, t in df.dtypes]
    doc_id = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("-"))
    return F.concat_ws(":", doc_id, text_crc32(), row_size(), F.xxhash64(*plain))


def reshard(rows: DataFrame, old_shard: str, shards: int, *, capacities: list[int] | None = None,
            cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot and row_name per row of ``rows`` (doc_id, text and the old shard's number).

    A row goes where its middle byte falls in its old shard; rows are in the order of
    falling size, then text_crc32 and doc_id there, so equal texts stay side by side and
    cuts mostly fall between small rows.  Each cut is off by half a row at most.  Slots count from 0
    without gaps in each new shard.  The plan sees one number per old shard.  Null texts
    are one byte; rows that repeat are rows of their own; an empty table gives an empty
    result.  Old shard numbers have to be 0, 1, 2 and so on; a null one is 0.
    """
    spark = rows.sparkSession
    with Work(spark) as work:
        narrow = work.kept(rows.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), row_size().alias("size"), text_crc32().alias("text_crc32"),
            F.coalesce(F.col(old_shard).cast("int"), F.lit(0)).alias("old_shard"), row_name(rows.drop(old_shard)).alias("row_name"),
        ), "shard-rows")
        found = {r["old_shard"]: r["bytes"] for r in narrow.groupBy("old_shard").agg(F.sum("size").alias("bytes")).collect()}
        sizes = [found.get(i, 0) for i in range(max(found, default=0) + 1)]
        flow = cheapest_flow(sizes, capacities or equal_capacities(sum(sizes), shards), cost)
        # One row per piece: a range of bytes of all old shards in a row, and where it goes.
        pieces, at = [], 0
        for i, row in enumerate(flow):
            for j, amount in enumerate(row):
                if amount:
                    pieces.append((i, at, at + amount, j))
                    at += amount
        narrow = narrow.withColumn("_less", -F.col("size"))
        ordered = sums_before(narrow, ["old_shard", "_less", "text_crc32", "doc_id", "row_name"], ["size"], "shard-order", work.kept)
        middle = F.col("before_size") + F.floor(F.col("size") / 2)
        table = spark.createDataFrame(pieces or [(0, 0, 0, 0)], "_old int, _from bigint, _to bigint, shard int")
        # At most old shards + new shards pieces carry bytes in a cheapest flow, or one per pair.
        placed = ordered.join(
            F.broadcast(table), (F.col("old_shard") == F.col("_old")) & (middle >= F.col("_from")) & (middle < F.col("_to"))
        ).select("doc_id", "size", "text_crc32", "old_shard", "shard", "row_name", F.lit(1).cast("bigint").alias("_one"))
        placed = work.kept(placed, "shard-placed")
        slots = sums_before(placed, ["shard", "old_shard", "text_crc32", "doc_id", "size", "row_name"], ["_one"], "shard-slots", work.kept)
        first = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("_rows")).collect()
        starts, total = [], 0
        for r in sorted(first, key=lambda r: r["shard"]):
            starts.append((r["shard"], total))
            total += r["_rows"]
        begun = spark.createDataFrame(starts or [(0, 0)], "_shard int, _start bigint")
        return kept(slots.join(F.broadcast(begun), F.col("shard") == F.col("_shard")).select(
            "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("before__one") - F.col("_start")).alias("slot"), "row_name"
        ), "shard-placements")


def affected_shards(placed: DataFrame) -> list[int]:
    """Shards whose files change: those that give rows to another shard or take rows from one."""
    moved = placed.where(F.col("old_shard") != F.col("shard"))
    both = moved.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    return sorted(r["shard"] for r in both.collect())


# Copies of one row that one task writes at most.
COPIES = 1000


def rewrite_affected(spark: SparkSession, docs: DataFrame, placed: DataFrame, folder: str) -> list[int]:
    """Write the rows of the affected shards below ``folder``, one sub-folder ``shard=N`` each; returns their numbers.

    The files of all other shards stay as they are.  Texts are shuffled once.  Of rows alike in all
    columns one passes, and is written as often as it has places in a shard; many copies are dealt
    over many tasks.  A column ``shard`` of ``docs`` is replaced by the new number.
    """
    changed = affected_shards(placed)
    name, times, block = unused(docs, "row_name", "times", "block")
    places = placed.where(F.col("shard").isin(changed)).groupBy(F.col("row_name").alias(name), "shard").agg(F.count(F.lit(1)).alias(times))
    rows = docs.withColumn(name, row_name(docs)).drop("shard")
    columns = [f"`{c}`" for c in docs.columns if c != "shard"]
    if placed.groupBy("row_name").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] in (None, 1):
        rows.join(places, name).select(*columns, "shard").write.partitionBy("shard").parquet(folder)
        return changed
    one = rows.dropDuplicates([name]).join(places, name)
    few = one.where(F.col(times) <= COPIES).withColumn(block, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int"))))
    few.select(*columns, "shard").write.partitionBy("shard").parquet(folder)
    often = places.where(F.col(times) > COPIES)
    if not often.isEmpty():
        texts = rows.join(often.select(name).distinct(), name, "left_semi").dropDuplicates([name]).join(often, name)
        dealt = texts.withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / COPIES)))).repartition(name, "shard", block)
        left = F.least(F.lit(COPIES), F.col(times) - F.col(block) * COPIES).cast("int")
        dealt.withColumn(times, F.explode(F.array_repeat(F.lit(1), left))).select(*columns, "shard").write.mode("append").partitionBy("shard").parquet(folder)
    return changed


def reshard_files(docs: DataFrame, old_shard: Column, shards: int) -> DataFrame:
    """Placements of :func:`reshard`, after the affected shards have been written below a new shared folder."""
    spark = docs.sparkSession
    (old,) = unused(docs, "old")
    placed = reshard(docs.withColumn(old, old_shard), old, shards)
    rewrite_affected(spark, docs, placed, new_path(spark, "resharded"))
    return placed
