"""Merkle manifest of a dataset: a nested-struct rollup, proofs without joins of leaves.

Rows are ranked within their language.  A rank, written in base eight, says where its leaf
stands: the last digit within its run, the digit before within the run of runs, and so on.
Blocks of 8^LEVELS nodes are rolled up by grouping away one digit after the other; each
group nests the structs of its children, so a block ends as one row that holds its subtree.
The blocks' digests are ranked nodes again, and are rolled up in the same way until one node is
left, per language first and then over the languages.

The way down takes each nested row apart again: a transform gives every child the digests beside
it, an explode makes it a row, and the row carries the steps from there to the root.
From one tier of blocks to the next the steps are handed down by grouping block rows with their header.
No row holds more than a block, and no leaf is ever joined.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import kept
from .common import sums_before

RUN = 8
LEVELS = 3
BLOCK = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEP = "struct<before:array<string>,after:array<string>>"


def digest_of(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings put one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """How a value enters a leaf: its length in bytes, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return digest_of(*[field(v) for v in values])


def ascii_lower(value: Column) -> Column:
    return F.translate(value, string.ascii_uppercase, string.ascii_lowercase)


def rolled(nodes: DataFrame) -> DataFrame:
    """Blocks of ``nodes`` (grp, rank, n, digest, own): grp, block, n, digest and the nested ``run``.

    ``n`` is the number of nodes of the group; where a level has one node left, it stays as it is.
    """
    digits = {f"_d{i}": F.floor(F.col("rank") / RUN**i) % RUN for i in range(LEVELS)}
    rows = nodes.select("grp", F.floor(F.col("rank") / BLOCK).alias("block"), "n", *[c.alias(k) for k, c in digits.items()], "digest", F.col("own").alias("below"))
    # One shuffle: the groupings below all hold the columns it deals by.
    rows = rows.repartition("grp", "block")
    for level in range(LEVELS):
        left = ["grp", "block", "n", *[f"_d{i}" for i in range(LEVELS - 1, level, -1)]]
        child = F.struct(F.col(f"_d{level}").alias("digit"), "digest", "below")
        rows = rows.groupBy(*left).agg(F.sort_array(F.collect_list(child)).alias("below"))
        joined = F.array_join(F.transform("below", lambda c: c["digest"]), "")
        rows = rows.withColumn("digest", F.when(F.col("n") > RUN**level, F.sha2(joined, 256)).otherwise(F.col("below")[0]["digest"]))
    return rows.select("grp", "block", "n", "digest", F.col("below").alias("run"))


def unrolled(blocks: DataFrame) -> DataFrame:
    """Each node of ``blocks`` (grp, n, run, head): grp, digest, own and head, its path longer by the steps within the block."""
    rows = blocks.select("grp", "n", "run", "head")
    for level in range(LEVELS - 1, -1, -1):
        def child(c: Column, i: Column) -> Column:
            before = F.transform(F.slice(F.col("run"), F.lit(1), i), lambda x: x["digest"])
            after = F.transform(F.slice(F.col("run"), i + 2, F.lit(RUN)), lambda x: x["digest"])
            return F.struct(c["digest"].alias("digest"), c["below"].alias("below"), F.struct(before.alias("before"), after.alias("after")).alias("step"))

        rows = rows.select("grp", "n", "head", F.explode(F.transform("run", child)).alias("_c"))
        path = F.concat(F.array("_c.step"), F.col("head.path"))
        longer = F.when(F.col("n") > RUN**level, path).otherwise(F.col("head.path"))
        head = F.struct(F.col("head.root").alias("root"), F.col("head.subroot").alias("subroot"), longer.alias("path"))
        rows = rows.select("grp", "n", head.alias("head"), F.col("_c.digest").alias("digest"), F.col("_c.below").alias("run"))
    return rows.select("grp", "digest", F.col("run").alias("own"), "head")


def tiers_of(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Tables of blocks, the lowest first, until every group is one block.  ``own`` of a higher node is its block's number."""
    most, tiers = nodes.agg(F.max("n").alias("n")).first()["n"] or 0, []
    while True:
        blocks = kept(rolled(nodes), label)
        tiers.append(blocks)
        most = -(-most // BLOCK)
        if most <= 1:
            return tiers
        nodes = blocks.select("grp", F.col("block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), "digest", F.struct(F.col("block").alias("block")).alias("own"))


def headed(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """``blocks`` with the ``head`` of the row of ``heads`` (grp, block, head) for the same block."""
    head, run = blocks.schema["run"].dataType, heads.schema["head"].dataType
    one = blocks.select("grp", "block", "n", "digest", "run", F.lit(None).cast(run).alias("head"))
    other = heads.select("grp", "block", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast(head).alias("run"), "head")
    met = one.unionByName(other).groupBy("grp", "block")
    return met.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "digest", "run", "head")])


def descended(tiers: list[DataFrame], heads: DataFrame, sub: bool = False) -> DataFrame:
    """From the heads of the last tier's blocks down to all nodes of the first."""
    for i, blocks in enumerate(reversed(tiers)):
        met = headed(blocks, heads)
        if sub and i == 0:
            met = met.withColumn("head", F.struct(F.col("head.root").alias("root"), F.col("digest").alias("subroot"), F.col("head.path").alias("path")))
        rows = unrolled(met)
        if i < len(tiers) - 1:
            heads = rows.select("grp", F.col("own.block").alias("block"), "head")
    return rows


def ranked(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``before__one``, how many rows sort earlier."""
    return sums_before(rows.withColumn("_one", F.lit(1).cast("bigint")), order, ["_one"], label)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(F.array_join(s["before"], ""), d, F.array_join(s["after"], "")), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all digests of a path, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: F.concat(s["before"], s["after"]))), ""), 256)


def manifest(docs: DataFrame, *, tampered: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, changed, subroot, root and path per row of ``docs``.

    A leaf is the digest of doc_id, source, lang, n_chars and text.  Leaves of a language ascend by
    doc_id (null first; equal ids by digest).  While a level has several nodes, each run of 8, the last
    one shorter, becomes the digest of its digests; the node left is the language's subroot, and the
    subroots, in the order of the languages' bytes with null first, lead to the root in the same way.
    ``path`` holds a step per level on the way from the leaf to the root: the digests before
    and after it in its run.  ``changed`` is the leaf with the text ``tampered`` in place of its own (null:
    as it is).  Null values are told from empty ones; repeated rows are leaves of their own; an empty
    table gives an empty result; further columns are not read.
    """
    own = [F.col(c) for c in FIELDS]
    leaf = leaf_of(*own)
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_of(*own[:-1], tampered))
    leaves = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("grp"), leaf.alias("digest"), other.alias("changed"))
    order = ranked(kept(leaves, "merkle-leaves"), ["grp", "doc_id", "digest"], "merkle-order").withColumnRenamed("before__one", "at")
    order = kept(order, "merkle-ranked")
    langs = order.groupBy("grp").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    langs = langs.withColumnRenamed("grp", "_grp")
    placed = order.join(langs, F.col("grp").eqNullSafe(F.col("_grp")))
    nodes = placed.select("grp", (F.col("at") - F.col("start")).alias("rank"), "n", "digest", F.struct("doc_id", "changed").alias("own"))
    tiers = tiers_of(nodes, "merkle-blocks")

    subroots = tiers[-1].select(F.col("grp").alias("lang"), "digest")
    tops = kept(ranked(subroots, ["lang"], "merkle-langs"), "merkle-tops")
    upper = tops.select(F.lit(None).cast("string").alias("grp"), F.col("before__one").alias("rank"), F.lit(tops.count()).cast("bigint").alias("n"), "digest", F.struct("lang").alias("own"))
    upper = tiers_of(upper, "merkle-upper")
    none = F.array().cast(f"array<{STEP}>")
    head = F.struct(F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"), none.alias("path")).alias("head")
    of_langs = descended(upper, upper[-1].select("grp", "block", head))
    heads = kept(of_langs.select(F.col("own.lang").alias("grp"), F.lit(0).cast("bigint").alias("block"), "head"), "merkle-heads")
    rows = descended(tiers, heads, sub=True)
    return rows.select("own.doc_id", F.col("grp").alias("lang"), F.col("digest").alias("leaf"), F.coalesce("own.changed", "digest").alias("changed"), "head.subroot", "head.root", "head.path")
