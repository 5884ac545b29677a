"""Batches of changes applied to a snapshot of the forest.

A batch has a sequence column ``seq`` that orders its requests.  Requests are
checked against the snapshot, not against each other, except where this module
says so; the result never depends on how Spark happened to order the rows.
Every operator returns its rejects with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import choose, stable_id, strip
from ..scratch import keep, kept
from .hierarchy import below_marked, climb, cycle_members, display_order, live_nodes, parent_link
from .keyed import HOT_ROWS, first_rows, last_rows, null_safe_join, rank_rows
from .tagging import match_parent

SIBLING_KEY = ["owner_id", "parent_id"]


def next_sort_order(nodes: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Order a new child would get, per (owner, parent); the roots' parent is null.

    ``exclude`` lists ids that do not count as siblings.
    """
    live = live_nodes(nodes)
    if exclude is not None:
        live = live.join(exclude.select("id"), "id", "left_anti")
    return live.groupBy(*SIBLING_KEY).agg((F.max("sort_order") + 1).alias("next_order"))


def append_order(
    nodes: DataFrame, arrivals: DataFrame, *, with_deleted: bool = False, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``arrivals`` with ``sort_order``: numbered by ``seq`` after the live children, or after all of them."""
    if with_deleted:
        nodes = nodes.withColumn("is_deleted", F.lit(False))
    ranked = rank_rows(arrivals, SIBLING_KEY, [F.col("seq")], "_rank", hot_rows=hot_rows)
    joined = null_safe_join(ranked, next_sort_order(nodes), SIBLING_KEY, "left")
    order = F.coalesce("next_order", F.lit(0.0)) + F.col("_rank") - 1
    columns = [c for c in arrivals.columns if c != "sort_order"]
    return joined.select(*columns, order.cast("double").alias("sort_order"))


def normalize_sibling_order(nodes: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Live nodes renumbered 0, 1, 2 ... among their siblings."""
    ranked = rank_rows(live_nodes(nodes), SIBLING_KEY, display_order(), "_rank", hot_rows=hot_rows)
    return ranked.withColumn("sort_order", (F.col("_rank") - 1).cast("double")).drop("_rank")


def sibling_name_clashes(nodes: DataFrame, *, enforce_root: bool = False) -> DataFrame:
    """(owner, parent, name) held by two or more live nodes."""
    live = live_nodes(nodes)
    if not enforce_root:
        live = live.where(F.col("parent_id").isNotNull())
    return live.groupBy(*SIBLING_KEY, "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def sibling_conflicts(incoming: DataFrame, nodes: DataFrame, *, enforce_root: bool = False) -> DataFrame:
    """Incoming rows whose name a live node already has under the same parent."""
    taken = live_nodes(nodes).select(*SIBLING_KEY, "name").distinct()
    if not enforce_root:
        incoming = incoming.where(F.col("parent_id").isNotNull())
    return null_safe_join(incoming, taken, [*SIBLING_KEY, "name"], "left_semi")


def _reject(rows: DataFrame, reason: str) -> DataFrame:
    return rows.withColumn("reason", F.lit(reason))


def apply_creates(
    nodes: DataFrame, creates: DataFrame, *, enforce_root: bool = False, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """New nodes for ``creates(seq, id, owner_id, parent_id, name)``, and rejects.

    Of several requests for one name under one parent the first wins.
    """
    named = creates.withColumn("name", strip(F.coalesce("name", F.lit(""))))
    empty = named.where(F.length("name") == 0)
    named = named.where(F.length("name") > 0)
    clash = sibling_conflicts(named, nodes, enforce_root=enforce_root)
    free = named.join(clash.select("seq"), "seq", "left_anti")
    guarded = free if enforce_root else free.where(F.col("parent_id").isNotNull())
    winners = first_rows(guarded, [*SIBLING_KEY, "name"], ["seq"])
    repeats = guarded.join(winners.select("seq"), "seq", "left_anti")
    accepted = free.join(repeats.select("seq"), "seq", "left_anti")
    rejects = _reject(empty, "empty_name").unionByName(_reject(clash, "name_taken")).unionByName(
        _reject(repeats, "name_taken_in_batch")
    )
    placed = append_order(nodes, accepted, hot_rows=hot_rows)
    return placed.withColumns({"content": F.lit(""), "is_deleted": F.lit(False)}), rejects


def apply_content_updates(nodes: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes after ``updates(seq, owner_id, id, content, at)``; the last write wins."""
    live = live_nodes(nodes).select("owner_id", "id")
    rejects = _reject(updates.join(live, ["owner_id", "id"], "left_anti"), "node_not_found")
    valid = updates.join(live, ["owner_id", "id"], "left_semi")
    last = last_rows(valid, ["owner_id", "id"], ["at", "seq"]).select(
        "owner_id", "id", F.col("content").alias("_content"), F.col("at").alias("_at")
    )
    joined = nodes.join(last, ["owner_id", "id"], "left")
    written = F.col("_at").isNotNull()
    changed = {"content": F.when(written, F.col("_content")).otherwise(F.col("content"))}
    old = F.col("updated_at") if "updated_at" in nodes.columns else F.lit(None).cast("timestamp")
    changed["updated_at"] = F.coalesce("_at", old)
    return joined.withColumns(changed).drop("_content", "_at"), rejects


def _known(requests: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    live = live_nodes(nodes).select("owner_id", "id")
    return requests.join(live, ["owner_id", "id"], "left_semi"), requests.join(live, ["owner_id", "id"], "left_anti")


def apply_cascade_delete(nodes: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes after soft-deleting ``deletes(owner_id, id)`` and all below them.

    A node goes if the walk upward from it meets one asked for; that needs no closure, and on a cycle, or below
    one, the walk meets every node there is to meet.
    """
    valid, unknown = _known(deletes, nodes)
    asked = valid.select("id").distinct().withColumn("marked", F.lit(True))
    links = parent_link(nodes).join(asked, "id", "left").fillna(False, ["marked"])
    gone = below_marked(links)
    gone = gone.select("id", F.lit(True).alias("_gone"))
    after = nodes.join(gone, "id", "left")
    flag = F.coalesce("_gone", F.col("is_deleted"))
    return after.withColumn("is_deleted", flag).drop("_gone").select(*nodes.columns), _reject(unknown, "node_not_found")


def apply_promote_delete(
    nodes: DataFrame, deletes: DataFrame, *, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Nodes after soft-deleting ``deletes(owner_id, id)`` alone.

    Their children move up to the nearest ancestor that stays, after its other
    children; a chain of deletes is climbed in one go.
    """
    valid, unknown = _known(deletes, nodes)
    asked = valid.select("id").distinct().withColumn("_gone", F.lit(True))
    linked = kept(parent_link(nodes, carry=("sort_order", "name")).join(asked, "id", "left").fillna(False, ["_gone"]), "promote")
    gone = linked.where("_gone")
    # The walk is over deleted nodes alone: each points to its parent if that goes too.
    also = gone.select(F.col("id").alias("up"), F.lit(True).alias("_also"))
    chains = gone.join(also, "up", "left").select("id", F.when(F.col("_also"), F.col("up")).alias("up"))
    # Above the top of a chain is a node that stays, or what the top pointed at.
    beyond = gone.select(F.col("id").alias("root"), F.coalesce("up", "parent_id").alias("_new_parent"))
    landing = climb(chains).join(beyond, "root", "left").select(F.col("id").alias("up"), "_new_parent")
    promoted = (
        linked.where(~F.col("_gone"))
        .join(landing, "up")
        .select("owner_id", "id", F.col("_new_parent").alias("parent_id"), F.struct("sort_order", "name", "id").alias("seq"))
    )
    staying = nodes.join(asked, "id", "left_anti")
    placed = append_order(staying, promoted, hot_rows=hot_rows).select(
        "id", F.col("parent_id").alias("_parent"), F.col("sort_order").alias("_order"), F.lit(True).alias("_moved")
    )
    after = nodes.join(placed, "id", "left").join(asked, "id", "left")
    changes = {
        "parent_id": F.when(F.col("_moved"), F.col("_parent")).otherwise(F.col("parent_id")),
        "sort_order": F.coalesce("_order", "sort_order"),
        "is_deleted": F.col("is_deleted") | F.coalesce("_gone", F.lit(False)),
    }
    return after.withColumns(changes).select(*nodes.columns), _reject(unknown, "node_not_found")


# --- moves -----------------------------------------------------------------------


def _moving_above(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """id and ``near``: the closest moving node at or above each live node.

    Only nodes that stay point upward, so one climb stops at the first mover.
    Every further question about a batch is then one about its movers alone.
    """
    movers = moves.select("id").distinct().withColumn("_mover", F.lit(True))
    links = parent_link(nodes).join(movers, "id", "left").fillna(False, ["_mover"])
    stops = links.select("id", F.when(~F.col("_mover"), F.col("up")).alias("up"), "_mover")
    tops = climb(stops, carry=("_mover",))
    reached = movers.select(F.col("id").alias("root"), F.col("id").alias("near"))
    return tops.join(reached, "root").select("id", "near")


def _judge(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` with ``reason``, the moving name, and the closest movers
    above the present parent (``above``) and at or above the new one (``ahead``)."""
    live = live_nodes(nodes)
    near = kept(_moving_above(nodes, moves), "movers")
    here = live.select("owner_id", "id", F.col("parent_id").alias("_from"), F.col("name").alias("_name"), F.lit(True).alias("_known"))
    there = live.select("owner_id", F.col("id").alias("new_parent_id"), F.lit(True).alias("_target"))
    taken = (
        live.where(F.col("parent_id").isNotNull())
        .select("owner_id", F.col("parent_id").alias("new_parent_id"), F.col("name").alias("_name"), F.lit(True).alias("_taken"))
        .distinct()
    )
    rows = moves.join(here, ["owner_id", "id"], "left").join(there, ["owner_id", "new_parent_id"], "left")
    rows = rows.join(taken, ["owner_id", "new_parent_id", "_name"], "left")
    rows = rows.join(near.select(F.col("id").alias("_from"), F.col("near").alias("above")), "_from", "left")
    rows = rows.join(near.select(F.col("id").alias("new_parent_id"), F.col("near").alias("ahead")), "new_parent_id", "left")

    # Movers above each mover: the node is among them if the new parent is below it.
    chain = rows.where("_known").select("id", F.col("above").alias("up"), F.col("id").alias("trail")).dropDuplicates(["id"])
    trails = climb(chain, trails=("trail",)).select(F.col("id").alias("ahead"), F.col("trail").alias("_trail"))
    rows = rows.join(trails, "ahead", "left")
    below = F.coalesce(F.array_contains("_trail", F.col("id")), F.lit(False)) | F.coalesce(F.col("id") == F.col("new_parent_id"), F.lit(False))
    reason = choose(
        [
            (F.col("_known").isNull(), F.lit("node_not_found")),
            (F.col("_from").eqNullSafe(F.col("new_parent_id")), F.lit("no_op")),
            (F.col("new_parent_id").isNotNull() & F.col("_target").isNull(), F.lit("parent_not_found")),
            (below, F.lit("own_descendant")),
            (F.col("_taken").isNotNull(), F.lit("name_taken")),
        ],
        F.lit(None).cast("string"),
    )
    return rows.withColumn("reason", reason).select(*moves.columns, "reason", "_name", "above", "ahead")


def move_conflicts(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves(seq, owner_id, id, new_parent_id)`` with ``reason``, the first that applies.

    null for a move that is fine, ``no_op`` if the node is already there.
    """
    return _judge(nodes, moves).select(*moves.columns, "reason")


def apply_moves(
    nodes: DataFrame, moves: DataFrame, *, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Nodes after the valid ``moves``, appended last at their destination, and rejects.

    One move per node and batch, the first; of two arrivals with one name at one
    parent the first wins; moves that would jointly close a cycle are rejected.
    If moves have a time ``at``, it becomes ``updated_at`` of the nodes they move.
    """
    single = first_rows(moves, ["owner_id", "id"], ["seq"])
    repeated = moves.join(single.select("seq"), "seq", "left_anti")
    judged = kept(_judge(nodes, single), "moves")
    named = judged.where(F.col("reason").isNull() & F.col("new_parent_id").isNotNull())
    winners = first_rows(named, ["owner_id", "new_parent_id", "_name"], ["seq"])
    losers = named.join(winners.select("seq"), "seq", "left_anti").select("seq", F.lit("name_taken_in_batch").alias("_lost"))
    judged = judged.join(losers, "seq", "left").withColumn("reason", F.coalesce("reason", "_lost")).drop("_lost")

    # A rejected mover keeps its old place, which can close another cycle: look
    # again until none is left.  Accepted movers that lead nowhere end the walk.
    while True:
        leads_on = F.col("reason").isNull() & F.col("ahead").isNotNull()
        judged, seen = keep(judged, "judged-moves", n=F.count_if(leads_on))
        if not seen.get("n"):
            break
        movers = judged.where(F.coalesce(F.col("reason") != "node_not_found", F.lit(True)))
        graph = movers.select("id", F.when(F.col("reason").isNull(), F.col("ahead")).otherwise(F.col("above")).alias("up"))
        accepted = judged.where(F.col("reason").isNull())
        cyclic = cycle_members(graph).join(accepted, "id", "left_semi").withColumn("_cyclic", F.lit(True))
        cyclic, found = keep(cyclic, "joint-cycles", n=F.count(F.lit(1)))
        if not found.get("n"):
            break
        broken = F.when(F.col("_cyclic"), F.lit("joint_cycle")).otherwise(F.col("reason"))
        judged = judged.join(cyclic, "id", "left").withColumn("reason", broken).drop("_cyclic")

    columns = [*moves.columns, "reason"]
    rejects = _reject(repeated, "moved_twice").select(*columns).unionByName(judged.where(F.col("reason").isNotNull()).select(*columns))
    accepted = judged.where(F.col("reason").isNull())
    timed = ["at"] if "at" in moves.columns and "updated_at" in nodes.columns else []
    arrivals = accepted.select("seq", "owner_id", "id", F.col("new_parent_id").alias("parent_id"), *timed)
    placed = append_order(nodes, arrivals, hot_rows=hot_rows).select(
        "id", F.col("parent_id").alias("_parent"), F.col("sort_order").alias("_order"), F.lit(True).alias("_moved"),
        *[F.col(c).alias("_at") for c in timed],
    )
    written = {
        "parent_id": F.when(F.col("_moved"), F.col("_parent")).otherwise(F.col("parent_id")),
        "sort_order": F.coalesce("_order", "sort_order"),
    }
    if timed:
        written["updated_at"] = F.coalesce("_at", "updated_at")
    return nodes.join(placed, "id", "left").withColumns(written).select(*nodes.columns), rejects


# --- generated nodes ----------------------------------------------------------------


def resolve_names(
    nodes: DataFrame, wanted: DataFrame, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``wanted(seq, owner_id, parent_id, name, ...)`` with ``final_name``.

    The first request for a free name gets it; the next, or the first for a
    taken name, gets the name with a suffix; any later one gets null.
    """
    live = live_nodes(nodes).select(*SIBLING_KEY, "name").distinct()
    plain = live.withColumn("_taken", F.lit(1))
    suffixed = live.withColumnsRenamed({"name": "_suffixed"}).withColumn("_suffix_taken", F.lit(1))
    asked = wanted.withColumn("_suffixed", F.concat("name", F.lit(V.DUPLICATE_NAME_SUFFIX)))
    asked = rank_rows(asked, [*SIBLING_KEY, "name"], [F.col("seq")], "_nth", hot_rows=hot_rows)
    rows = null_safe_join(asked, plain, [*SIBLING_KEY, "name"], "left")
    rows = null_safe_join(rows, suffixed, [*SIBLING_KEY, "_suffixed"], "left")
    nth = F.col("_nth") + F.coalesce("_taken", F.lit(0))
    name = F.when(nth == 1, F.col("name")).when((nth == 2) & F.col("_suffix_taken").isNull(), F.col("_suffixed"))
    rows = rows.withColumn("final_name", name).drop("_nth", "_taken", "_suffixed", "_suffix_taken")
    # A suffixed name may also have been asked for as such: the first stays.
    named = rows.where(F.col("final_name").isNotNull())
    winners = first_rows(named.select(*SIBLING_KEY, "final_name", "seq"), [*SIBLING_KEY, "final_name"], ["seq"])
    won = winners.select("seq", F.lit(True).alias("_won"))
    return rows.join(won, "seq", "left").withColumn("final_name", F.when(F.col("_won"), F.col("final_name"))).drop("_won")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


MADE = "array<struct<label:string,root:boolean,key:string,parent:string,name:string,chain:array<bigint>>>"
AIMED = "array<struct<seq:bigint,key:string,chain:array<bigint>,fresh:boolean,lost:boolean>>"


def _aim(acc: Column, item: Column) -> Column:
    """One more suggestion of a response: its place, seeing the nodes that the response has made so far.

    A place is ``n`` and an id, ``r`` and the name of a new root, or ``i`` and the number of an earlier suggestion;
    ``chain`` lists the suggestions above it.
    """

    def at(key: Column, chain: Column, fresh: bool) -> Column:
        return F.struct(key.alias("key"), chain.cast("array<bigint>").alias("chain"), F.lit(fresh).alias("fresh"))

    none = F.array()
    fits = F.filter(acc["made"], lambda m: F.contains(m["label"], item["wanted"]) | F.contains(item["wanted"], m["label"]))
    own_key = F.concat(F.lit("n"), item["match"].cast("string"))
    known = F.when(item["match"].isNotNull(), at(own_key, none, False))

    def placed(fits: Column) -> Column:
        roots = F.filter(fits, lambda m: m["root"])

        def first(found: Column) -> Column:
            return F.when(F.size(found) > 0, at(F.get(found, F.lit(0))["key"], F.get(found, F.lit(0))["chain"], False))

        fresh = at(F.concat(F.lit("r"), item["wanted"]), none, True)
        return F.coalesce(F.when(item["is_root"], known), first(roots), known, first(fits), fresh)

    def named(place: Column) -> Column:
        def taken(name: Column, stored: Column) -> Column:
            here = F.coalesce(place["key"] == own_key, F.lit(False)) & stored
            return here | F.exists(acc["made"], lambda m: (m["parent"] == place["key"]) & (m["name"] == name))

        suffixed = F.concat(item["name"], F.lit(V.DUPLICATE_NAME_SUFFIX))
        return F.when(~taken(item["name"], item["taken"]), item["name"]).when(~taken(suffixed, item["suffix_taken"]), suffixed)

    def made(label: Column, root: bool, key: Column, parent: Column, name: Column, chain: Column) -> Column:
        return F.array(F.struct(label.alias("label"), F.lit(root).alias("root"), key.alias("key"), parent.alias("parent"),
                                name.alias("name"), chain.cast("array<bigint>").alias("chain"))).cast(MADE)

    def added(place: Column, name: Column) -> Column:
        root = made(item["wanted"], True, place["key"], F.lit(""), item["suggested"], none)
        child = made(F.lower(name), False, F.concat(F.lit("i"), item["seq"].cast("string")), place["key"], name,
                     F.concat(place["chain"], F.array(item["seq"])))
        aimed = F.array(F.struct(item["seq"].alias("seq"), place["key"].alias("key"), place["chain"].alias("chain"),
                                 place["fresh"].alias("fresh"), name.isNull().alias("lost"))).cast(AIMED)
        nothing = none.cast(MADE)
        return F.struct(
            F.concat(acc["made"], F.when(place["fresh"], root).otherwise(nothing), F.when(name.isNotNull(), child).otherwise(nothing)).alias("made"),
            F.concat(acc["aimed"], aimed).alias("aimed"),
        )

    return _let(_let(fits, placed), lambda place: _let(named(place), lambda name: added(place, name)))


def place_generated_nodes(
    nodes: DataFrame, suggestions: DataFrame, *, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Inserts for ``suggestions(seq, owner_id, name, content, suggested_parent[, response_id])``, and the skipped.

    A suggestion goes under its best matching node: a root first, stored before new; an empty parent name matches
    every node.  Without a match a new root of that name is made.  The suggestions of one response are taken in the
    order of ``seq`` and see what earlier ones of it have made; without ``response_id`` each is a response of its own.
    Responses of a batch are judged against the snapshot, not against each other: new roots of one owner and name,
    ignoring case, become one, a name asked for twice under one parent gets a suffix, any further one is skipped, and
    so are the nodes of its response below it.  New nodes come after all siblings, deleted ones included.  ``seq`` is
    unique; a null name or parent name is skipped.

    A response was one text before it was split into rows, so it bounds the list that is folded.
    """
    kind = nodes.schema["id"].dataType
    response = F.col("response_id" if "response_id" in suggestions.columns else "seq")
    rows = suggestions.select(
        F.col("seq").cast("bigint").alias("seq"), "owner_id", response.alias("_response"), "name", "content", "suggested_parent"
    )
    nameless = rows.where(F.col("name").isNull() | F.col("suggested_parent").isNull())
    asked = rows.where(F.col("name").isNotNull() & F.col("suggested_parent").isNotNull()).withColumn("wanted", F.lower("suggested_parent"))
    found = match_parent(asked, nodes).select("owner_id", "wanted", F.col("parent_id").alias("_match"), "is_root")
    asked = asked.join(found, ["owner_id", "wanted"], "left").withColumn("_suffixed", F.concat("name", F.lit(V.DUPLICATE_NAME_SUFFIX)))
    children = live_nodes(nodes).where(F.col("parent_id").isNotNull()).select("owner_id", F.col("parent_id").alias("_match"), "name").distinct()
    asked = asked.join(children.withColumn("_taken", F.lit(True)), ["owner_id", "_match", "name"], "left")
    suffixed = children.withColumnRenamed("name", "_suffixed").withColumn("_suffix_taken", F.lit(True))
    asked = kept(asked.join(suffixed, ["owner_id", "_match", "_suffixed"], "left"), "suggestions")

    no = F.lit(False)
    item = F.struct(
        "seq", "name", F.col("suggested_parent").alias("suggested"), "wanted", F.col("_match").alias("match"), F.coalesce("is_root", no).alias("is_root"),
        F.coalesce("_taken", no).alias("taken"), F.coalesce("_suffix_taken", no).alias("suffix_taken"),
    )
    empty = F.struct(F.array().cast(MADE).alias("made"), F.array().cast(AIMED).alias("aimed"))
    folded = asked.groupBy("owner_id", "_response").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    aims = folded.select(F.inline(F.aggregate("_items", empty, _aim, lambda acc: acc["aimed"])))
    own_id = stable_id(kind, F.col("owner_id"), F.lit("item"), F.col("seq"), F.col("name"), F.col("content"))
    aimed = kept(asked.join(aims, "seq").withColumn("id", own_id), "aimed-suggestions")

    fresh = first_rows(
        aimed.where("fresh").select("owner_id", "wanted", "seq", F.col("suggested_parent").alias("name")), ["owner_id", "wanted"], ["seq"]
    )

    def root_id(wanted: Column) -> Column:
        return stable_id(kind, F.col("owner_id"), F.lit("root"), wanted)

    roots = fresh.withColumns({"id": root_id(F.col("wanted")), "parent_id": F.lit(None).cast(kind), "content": F.lit("")})
    root_rows = append_order(nodes, roots, with_deleted=True, hot_rows=hot_rows)

    above = aimed.select(F.col("seq").alias("_above"), F.col("id").alias("_made"))
    aimed = aimed.withColumn("_above", F.get("chain", F.size("chain") - 1)).join(above, "_above", "left")
    way = F.substring("key", 1, 1)
    parent = F.when(way == "n", F.col("_match")).when(way == "r", root_id(F.expr("substring(key, 2)"))).otherwise(F.col("_made"))
    good = aimed.where(~F.col("lost")).select("seq", "owner_id", parent.alias("parent_id"), "name", "content", "id", "chain")
    named = kept(resolve_names(nodes, good, hot_rows=hot_rows), "named-suggestions")
    unnamed = named.where(F.col("final_name").isNull())
    below = named.select("seq", F.explode("chain").alias("_above")).join(unnamed.select(F.col("seq").alias("_above")), "_above", "left_semi")
    orphaned = named.where(F.col("final_name").isNotNull()).join(below.select("seq"), "seq", "left_semi")
    good = named.where(F.col("final_name").isNotNull()).join(below.select("seq"), "seq", "left_anti").withColumn("name", F.col("final_name"))
    child_rows = append_order(nodes, good.drop("final_name", "chain"), with_deleted=True, hot_rows=hot_rows)
    columns = ["seq", "owner_id", "id", "parent_id", "name", "content", "sort_order"]
    inserts = root_rows.select(*columns).withColumn("is_new_root", F.lit(True)).unionByName(
        child_rows.select(*columns).withColumn("is_new_root", F.lit(False))
    )

    def skipped(rows: DataFrame, reason: Column) -> DataFrame:
        return rows.select("seq", "owner_id", "name", reason.alias("reason"))

    twice = F.lit("name_taken_twice")
    lost = skipped(aimed.where("lost"), twice).unionByName(skipped(unnamed, twice)).unionByName(skipped(orphaned, F.lit("parent_skipped")))
    return inserts, lost.unionByName(skipped(nameless, F.when(F.col("name").isNull(), F.lit("no_name")).otherwise(F.lit("no_parent_name"))))


def place_extracted_nodes(
    nodes: DataFrame, extracted: DataFrame, *, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Inserts for ``extracted(seq, owner_id, parent_id, name, content)``: children of a known node."""
    kind = nodes.schema["id"].dataType
    named = resolve_names(nodes, extracted, hot_rows=hot_rows)
    good = named.where(F.col("final_name").isNotNull()).withColumn("name", F.col("final_name")).drop("final_name")
    good = good.withColumn("id", stable_id(kind, F.col("owner_id"), F.col("parent_id"), F.col("name"), F.col("seq")))
    skipped = named.where(F.col("final_name").isNull()).select("seq", "owner_id", "name", F.lit("name_taken_twice").alias("reason"))
    return append_order(nodes, good, with_deleted=True, hot_rows=hot_rows), skipped


def placement_summary(inserts: DataFrame, skipped: DataFrame) -> DataFrame:
    """Created and skipped counts per owner."""
    marked = inserts.select("owner_id", F.lit(1).alias("c"), F.lit(0).alias("s")).unionByName(
        skipped.select("owner_id", F.lit(0).alias("c"), F.lit(1).alias("s"))
    )
    return marked.groupBy("owner_id").agg(F.sum("c").alias("created"), F.sum("s").alias("skipped"))
