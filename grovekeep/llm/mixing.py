"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a random key by hashing; rows are range-sorted by source and key;
running totals of sizes come from a distributed prefix sum; each source is cut at
its exact budget, whole passes over the source being repeated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import kept
from .common import WORD, sums_before, text_key, unused


def n_words(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("bigint")


def water_levels(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``target`` per source (source, weight, source_size).

    The targets add up to ``share`` times all sizes, by weight; no target is above
    ``most`` times its source's size, what is cut off going to the others by weight.
    Each pass adds up the sources that are full and those that are not; one row
    reaches the driver per pass.
    """
    sources = sources.withColumn("_most", F.col("source_size") * F.lit(float(most)))
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("_most") <= F.lit(level) * F.col("weight")
        sums = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, F.col("_most")).otherwise(0.0)).alias("full"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weights"),
        ).first()
        if not sums["total"] or not sums["weights"]:
            break
        risen = (float(share) * sums["total"] - sums["full"]) / sums["weights"]
        if level is not None and risen <= level:
            break
        level = risen
    target = F.col("_most") if level is None else F.least(F.col("_most"), F.lit(level) * F.col("weight"))
    return sources.withColumn("target", target.cast("double")).drop("_most")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, text_key, size, source_size, target and taken per row of ``docs``.

    Sources in the order of code points, null last, have ``weights`` in turn.  A source's
    budget is its target rounded down.  ``taken`` counts the words a row gives: its size
    for every whole pass that fits into the budget, and of the last, partial pass, in the
    order of a hash of the id, what lies before the budget's end; so the words taken from
    a source are exactly its budget, and the row at the cut gives its first words.  Null
    texts have no words and are taken zero times; repeated rows are rows of their own;
    an empty table gives an empty result.  The order depends on ids alone: reruns agree.
    """
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        text_key().alias("text_key"), n_words().alias("size"),
    )
    sized = kept(sized, "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = kept(sources.withColumn("_none", F.col("source").isNull()), "mix-sources")
    one = sources.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = sums_before(one, ["_none", "source"], ["_one"], "mix-ranks")
    turn = F.lit(None)
    for i, weight in enumerate(weights):
        turn = F.when(F.col("before__one") % len(weights) == i, F.lit(weight)).otherwise(turn)
    targets = water_levels(kept(ranked.select("source", "source_size", turn.cast("bigint").alias("weight")), "mix-weights"), share, most)

    keyed = sized.withColumns({"_none": F.col("source").isNull(), "_key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))})
    order = ["_none", "source", "_key", "doc_id", "size", "text_key"]
    running = sums_before(keyed, order, ["size"], "mix-order").withColumnRenamed("source", "_source")
    starts = sums_before(sources, ["_none", "source"], ["source_size"], "mix-starts")
    targets = targets.withColumnRenamed("source", "_of")
    budgets = targets.join(
        starts.select(F.col("source").alias("_from"), F.col("before_source_size").alias("_start")), F.col("_of").eqNullSafe(F.col("_from"))
    )
    budget = F.floor("target")
    joined = running.join(budgets, F.col("_source").eqNullSafe(F.col("_of")))
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - passes * F.col("source_size") - (F.col("before_size") - F.col("_start"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select(
        "doc_id", "text_key", "size", "source_size", "target",
        (passes * F.col("size") + part).cast("bigint").alias("taken"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, n.cast("int")), "")


def take_mixture(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of the mixture, with the columns of ``docs``: a row per whole pass, and one row cut to the words taken of the last.

    ``n_chars``, where ``docs`` has it, is that of the cut text.  Rows that give no word are left out.
    """
    # Repeated rows are matched by their place among the rows that are alike: of those, the first ``_n``
    # of the first pair take its words, and so on; only so many pairs are there as ways to be cut.
    size, takes, taken, n, of, key, here, key_here, place, words = unused(docs, "size", "takes", "taken", "n", "id", "key", "id_here", "key_here", "place", "words")
    counted = mixed.where(F.col("taken") > 0).groupBy("doc_id", "text_key", "size", "taken").agg(F.count(F.lit(1)).alias("_n"))
    plan = counted.groupBy("doc_id", "text_key", "size").agg(F.sort_array(F.collect_list(F.struct("taken", "_n"))).alias(takes), F.sum("_n").alias(n))
    plan = plan.withColumnsRenamed({"doc_id": of, "text_key": key, "size": size} if size != "size" else {"doc_id": of, "text_key": key})
    keyed = docs.withColumns({here: F.col("doc_id").cast("bigint"), key_here: text_key()})
    match = F.col(here).eqNullSafe(F.col(of)) & (F.col(key_here) == F.col(key))
    single = keyed.join(plan.where(F.col(n) == 1), match).withColumn(taken, F.col(takes)[0]["taken"])
    several = keyed.join(plan.where(F.col(n) > 1), match).withColumn(place, F.row_number().over(Window.partitionBy(here, key_here).orderBy(key_here)))
    # Counts are used up pair by pair; past the last one a row gives nothing.
    start = F.struct(F.col(place).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("found"))
    step = lambda a, p: F.struct(
        (a["left"] - p["_n"]).alias("left"), F.when((a["left"] > 0) & (a["left"] <= p["_n"]), p["taken"]).otherwise(a["found"]).alias("found"))
    several = several.withColumn(taken, F.aggregate(takes, start, step)["found"]).drop(place)
    rows = single.unionByName(several)
    passes = F.floor(F.col(taken) / F.col(size)).cast("int")
    rest = (F.col(taken) % F.col(size)).cast("int")
    shares = F.concat(F.array_repeat(F.col(size).cast("int"), passes), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn(words, F.explode(shares))
    cut = F.col(words) < F.col(size)
    text = F.when(cut, first_words(F.col("text"), F.col(words))).otherwise(F.col("text"))
    out = {"text": text}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out["n_chars"] = F.when(cut, F.length(text).cast(kind)).otherwise(F.col("n_chars"))
    return rows.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])
