"""Forests of parent pointers: depth, roots, paths, totals, order.

Everything recursive rests on :func:`climb`, pointer doubling: after k rounds a
row knows its 2**k-th ancestor, so a forest of depth d needs about log2(d)
rounds of one shuffle pair each, whatever its shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Rounds, kept
from .keyed import HOT_ROWS, rank_rows, running_sums

SIBLINGS = ["owner_id", "up"]
LEAF_EXPONENT = 0.6
# Longest part of a subtree's text, in characters.
PART_CHARS = 1_000_000


def display_order() -> list[Column]:
    return [F.col("sort_order"), F.col("name"), F.col("id")]


def live_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("is_deleted"))


def parent_link(nodes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Live nodes with ``up``: the parent, if it is live and has the same owner.

    ``is_orphan`` marks nodes that name a parent but cannot be attached to it.
    """
    live = live_nodes(nodes)
    parents = live.select(F.col("owner_id").alias("_owner"), F.col("id").alias("_parent"))
    names = dict.fromkeys(["owner_id", "id", "parent_id", *carry])
    return (
        live.select(*names)
        .join(parents, (F.col("owner_id") == F.col("_owner")) & (F.col("parent_id") == F.col("_parent")), "left")
        .withColumn("is_orphan", F.col("parent_id").isNotNull() & F.col("_parent").isNull())
        .withColumnRenamed("_parent", "up")
        .drop("_owner")
    )


def orphan_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is absent, deleted or someone else's."""
    live = live_nodes(nodes)
    child = live.where(F.col("parent_id").isNotNull())
    parent = live.select(F.col("owner_id").alias("_owner"), F.col("id").alias("_parent"))
    on = (F.col("owner_id") == F.col("_owner")) & (F.col("parent_id") == F.col("_parent"))
    return child.join(parent, on, "left_anti")


def climb(
    links: DataFrame,
    *,
    sums: tuple[str, ...] = (),
    trails: tuple[str, ...] = (),
    totals: tuple[str, ...] = (),
    height: bool = False,
    carry: tuple[str, ...] = (),
    wrap: bool = False,
) -> DataFrame:
    """Follow ``up`` from every row of ``links(id, up, ...)`` to its root.

    Returns id, root and depth, plus
    ``sums``    each column added up from the row to its root, both included;
    ``trails``  each column listed from the root down to the row;
    ``totals``  each column added up over the row and everything below it;
    ``height``  distance to the deepest row below;
    ``carry``   columns passed through unchanged.

    Rows in or below a cycle never reach a root: root and depth are null and the
    other results are partial.  With ``wrap`` the loop goes on until the trails
    of such rows have come round, so that they hold every row of the walk.
    """
    up = F.col("up")
    state = links.select(
        "id",
        up.alias("jump"),
        F.when(up.isNull(), F.col("id")).alias("root"),
        F.when(up.isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("depth"),
        *sums,
        *[F.array(c).alias(c) for c in trails],
        *totals,
        *([F.lit(0).cast("bigint").alias("height")] if height else []),
        *carry,
    )
    open_rows = F.col("jump").isNotNull()
    if wrap:
        trail = F.col(trails[0])
        open_rows = open_rows & (F.size(F.array_distinct(trail)) == F.size(trail))

    rounds = Rounds(links.sparkSession, "climb")
    step, before = 1, None
    while True:
        state, seen = rounds.write(state, open=F.count_if(open_rows))
        left = seen.get("open", 0)
        # While any acyclic row is open, the number of open rows falls.
        if left == 0 or (left == before and not wrap):
            break
        before = left
        state = _double(state, step, sums, trails, totals, height)
        if wrap:
            # A walk that has come round goes no further.
            state = state.withColumn("jump", F.when(F.size(F.array_distinct(trails[0])) == F.size(trails[0]), F.col("jump")))
        step *= 2
    return state.drop("jump").withColumn("depth", F.when(F.col("root").isNotNull(), F.col("depth")))


def _double(state, step, sums, trails, totals, height) -> DataFrame:
    """One round: hand totals to the row ``step`` above, then jump twice as far."""
    base = state
    if totals or height:
        mail = [F.sum(c).alias(f"_{c}") for c in totals]
        if height:
            mail.append((F.max("height") + F.lit(step)).alias("_height"))
        posted = state.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("id")).agg(*mail)
        base = state.join(posted, "id", "left")
        for c in totals:
            base = base.withColumn(c, F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)))
        if height:
            base = base.withColumn("height", F.greatest("height", F.coalesce("_height", F.lit(0))))
        base = base.select(*state.columns)
    ahead = state.select(
        F.col("id").alias("jump"),
        F.col("jump").alias("_jump"),
        F.col("root").alias("_root"),
        F.col("depth").alias("_depth"),
        *[F.col(c).alias(f"_{c}") for c in [*sums, *trails]],
    )
    moved = base.where(F.col("jump").isNotNull()).join(ahead, "jump")
    moved = moved.withColumns(
        {
            "jump": F.col("_jump"),
            "root": F.col("_root"),
            "depth": F.col("depth") + F.col("_depth"),
            **{c: F.col(c) + F.col(f"_{c}") for c in sums},
            **{c: F.concat(f"_{c}", c) for c in trails},
        }
    ).select(*state.columns)
    return moved.unionByName(base.where(F.col("jump").isNull()))


def below_marked(links: DataFrame) -> DataFrame:
    """ids of ``links(id, up, marked)`` whose walk upward, itself included, meets a marked row.

    Pointer doubling with a flag, so a row stays as narrow on a cycle as on a path.  A row that has met a mark
    goes no further.  A round that closes no row proves that no mark is left to meet: if a row met one only in
    a later round, the row one jump ahead of it would have met it now, and so would the row itself.
    """
    state = links.select("id", F.when(~F.col("marked"), F.col("up")).alias("jump"), "marked")
    is_open = F.col("jump").isNotNull()
    rounds = Rounds(links.sparkSession, "below-marked")
    before = None
    while True:
        state, seen = rounds.write(state, open=F.count_if(is_open))
        left = seen.get("open", 0)
        if left in (0, before):
            return state.where("marked").select("id")
        before = left
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("marked").alias("_marked"))
        moved = state.where(is_open).join(ahead, "jump").select("id", F.col("_jump").alias("jump"), F.col("_marked").alias("marked"))
        state = moved.unionByName(state.where(~is_open))


def cycle_members(links: DataFrame) -> DataFrame:
    """ids of ``links(id, up)`` that lie on a cycle; those that only lead to one are left out.

    Each round keeps the rows that some row jumps to and whose own jump leads on, and jumps twice as far.  Rows of
    a cycle always stay; when all rows stay, the jumps permute them, so all are on cycles.
    """
    state = links.where(F.col("up").isNotNull()).select("id", F.col("up").alias("jump"))
    rounds = Rounds(links.sparkSession, "cycle-members")
    before = None
    while True:
        state, seen = rounds.write(state, rows=F.count(F.lit(1)))
        left = seen.get("rows", 0)
        if left in (0, before):
            return state.select("id")
        before = left
        met = state.select(F.col("jump").alias("id")).distinct()
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"))
        state = state.join(met, "id", "left_semi").join(ahead, "jump").select("id", F.col("_jump").alias("jump"))


def with_cycle_flag(climbed: DataFrame) -> DataFrame:
    return climbed.withColumn("in_cycle", F.col("root").isNull())


def node_depth(nodes: DataFrame) -> DataFrame:
    """owner_id, id, root, depth, in_cycle for every live node; orphans have depth 0."""
    return with_cycle_flag(climb(parent_link(nodes), carry=("owner_id",)))


def tree_root(nodes: DataFrame) -> DataFrame:
    return node_depth(nodes).select("owner_id", "id", F.col("root").alias("root_id"))


def reachable_nodes(nodes: DataFrame) -> DataFrame:
    """Live nodes a walk from the roots and orphans reaches."""
    return node_depth(nodes).where(~F.col("in_cycle")).drop("in_cycle")


def cycle_nodes(nodes: DataFrame) -> DataFrame:
    """Live nodes in or below a cycle, for a data-quality report."""
    return node_depth(nodes).where("in_cycle").select("owner_id", "id")


def ancestor_path(nodes: DataFrame, *, exclude_self: bool = False) -> DataFrame:
    """id and ``path``, root first, through deleted and foreign ancestors too.

    On a cycle the path holds each node of the walk once.
    """
    known = nodes.select(F.col("id").alias("up"))
    links = nodes.select("owner_id", "id", "parent_id", F.col("id").alias("path")).join(
        known, F.col("parent_id") == F.col("up"), "left"
    )
    climbed = climb(links, trails=("path",), carry=("owner_id",), wrap=True)
    path = F.when(F.col("root").isNotNull(), F.col("path")).otherwise(
        F.reverse(F.array_distinct(F.reverse("path")))
    )
    if exclude_self:
        path = F.slice(path, 1, F.size(path) - 1)
    return climbed.select("owner_id", "id", path.alias("path"))


def descendant_closure(nodes: DataFrame) -> DataFrame:
    """Every (ancestor, descendant, distance) pair of live nodes."""
    links = parent_link(nodes).withColumn("path", F.col("id"))
    climbed = climb(links, trails=("path",), carry=("owner_id",)).where(F.col("root").isNotNull())
    return (
        climbed.select("owner_id", F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("_at", "ancestor"))
        .where(F.col("_at") < F.col("depth"))
        .select("owner_id", "ancestor", "descendant", (F.col("depth") - F.col("_at")).alias("distance"))
    )


def self_union_descendants(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """Closure plus every live node as its own member at distance 0."""
    own = live_nodes(nodes).select(
        "owner_id", F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).cast("bigint").alias("distance")
    )
    return closure.unionByName(own)


# Display-order positions per bin of a range join.
BIN = 256


def _within(spans: DataFrame, order: DataFrame) -> DataFrame:
    """``spans(owner_id, _from, _to, ...)`` with ``_pos`` and ``_member``, each node at a position of [_from, _to).

    Both sides are filed under bins of positions, so a hot owner is many keys, and a span of n nodes takes about
    n / BIN rows before it meets them.
    """
    bins = F.sequence(F.floor(F.col("_from") / BIN), F.floor((F.col("_to") - 1) / BIN))
    points = order.select("owner_id", F.floor(F.col("pos") / BIN).alias("_bin"), F.col("pos").alias("_pos"), F.col("id").alias("_member"))
    met = spans.withColumn("_bin", F.explode(bins)).join(points, ["owner_id", "_bin"])
    return met.where((F.col("_pos") >= F.col("_from")) & (F.col("_pos") < F.col("_to"))).drop("_bin")


def blocked_move_targets(moving: DataFrame, order: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each moving live node, the nodes it may not be moved under: itself and those below it.

    ``order`` is the result of :func:`preorder_rows`; a node on a cycle, which has no place there, blocks itself.
    """
    asked = moving.select("owner_id", "id").distinct()
    spans = order.select("owner_id", "id", F.col("pos").alias("_from"), (F.col("pos") + F.col("subtree_size")).alias("_to"))
    blocked = _within(spans.join(asked, ["owner_id", "id"], "left_semi"), order)
    live = live_nodes(nodes).select("owner_id", "id").join(asked, ["owner_id", "id"], "left_semi")
    placeless = live.join(order.select("owner_id", "id"), ["owner_id", "id"], "left_anti")
    return blocked.select("owner_id", "id", F.col("_member").alias("blocked_id")).unionByName(placeless.withColumn("blocked_id", F.col("id")))


def child_count(nodes: DataFrame) -> DataFrame:
    """Live children of every live node, 0 for leaves."""
    counted = _children_per_parent(nodes)
    return live_nodes(nodes).select("owner_id", "id").join(counted, ["owner_id", "id"], "left").fillna(0, ["child_count"])


def _children_per_parent(nodes: DataFrame) -> DataFrame:
    child = live_nodes(nodes).where(F.col("parent_id").isNotNull())
    return child.groupBy("owner_id", F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("child_count"))


def subtree_shape(nodes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """root, depth, subtree_size, height and leaves of every live node.

    Totals travel up along the doubled pointers, so no ancestor pair is ever
    built and a chain costs no more than a bush of equal size.
    """
    links = (
        parent_link(nodes, carry=carry)
        .join(_children_per_parent(nodes), ["owner_id", "id"], "left")
        .fillna(0, ["child_count"])
        .withColumn("subtree_size", F.lit(1).cast("bigint"))
        .withColumn("leaves", F.when(F.col("child_count") == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    )
    kept_columns = tuple(dict.fromkeys(["owner_id", "up", "child_count", *carry]))
    shape = with_cycle_flag(climb(links, totals=("subtree_size", "leaves"), height=True, carry=kept_columns))
    blank = {c: F.when(~F.col("in_cycle"), F.col(c)) for c in ("subtree_size", "leaves", "height")}
    return shape.withColumns(blank)


def leaf_weights(shape: DataFrame, *, floor: float = 1.0, scale: float = 8.0) -> DataFrame:
    """Leaves under each node and their power-law weight against the owner's largest."""
    known = shape.where(~F.col("in_cycle"))
    largest = known.groupBy("owner_id").agg(F.max("leaves").alias("_most"))
    share = F.col("leaves") / F.col("_most")
    weight = F.when(F.col("child_count") == 0, F.lit(floor)).otherwise(
        F.greatest(F.lit(floor), F.lit(scale) * F.pow(share, F.lit(LEAF_EXPONENT)))
    )
    return known.join(largest, "owner_id").select("owner_id", "id", "leaves", weight.alias("weight"))


def sibling_rank(nodes: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Position of each live node among those with the same stored parent."""
    live = live_nodes(nodes).select("owner_id", "id", "parent_id", "sort_order", "name")
    return rank_rows(live, ["owner_id", "parent_id"], display_order(), "position", hot_rows=hot_rows)


def preorder_rows(nodes: DataFrame, *, orphans: str = "root", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The forest in display order: level, ``pos`` and ``path_key``.

    A node's position is the sum, along its path, of the sizes of the subtrees
    shown before it among its siblings, so no global sort of paths is needed.
    ``orphans='drop'`` leaves out trees whose top names a missing parent.
    """
    shape = subtree_shape(nodes, carry=("sort_order", "name", "parent_id")).where(~F.col("in_cycle"))
    if orphans == "drop":
        tops = shape.where(F.col("up").isNull() & F.col("parent_id").isNull()).select(F.col("id").alias("root"))
        shape = shape.join(tops, "root", "left_semi")
    elif orphans != "root":
        raise ValueError("orphans must be 'root' or 'drop'")
    shape = shape.select("owner_id", "id", "up", "sort_order", "name", "subtree_size")
    sums = {"_through": F.col("subtree_size"), "path_key": F.lit(1).cast("bigint")}
    placed = running_sums(shape, SIBLINGS, display_order(), sums, hot_rows=hot_rows)
    below = F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.lit(1))
    placed = placed.withColumn("pos", F.col("_through") - F.col("subtree_size") + below)
    carried = ("owner_id", "up", "name", "subtree_size")
    rows = climb(placed, sums=("pos",), trails=("path_key",), carry=carried)
    return rows.select(
        "owner_id", "id", F.col("up").alias("parent_id"), "name", "root", F.col("depth").alias("level"),
        "subtree_size", "pos", "path_key",
    )


def is_descendant(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """``pairs(owner_id, ancestor, candidate)`` with ``is_descendant``.

    ``order`` is the result of :func:`preorder_rows`: a subtree is the interval
    [pos, pos + size), so the test is two lookups and no closure.
    """
    a = order.select("owner_id", F.col("id").alias("ancestor"), F.col("pos").alias("_a"), F.col("subtree_size").alias("_n"))
    c = order.select("owner_id", F.col("id").alias("candidate"), F.col("pos").alias("_c"))
    inside = (F.col("_c") > F.col("_a")) & (F.col("_c") < F.col("_a") + F.col("_n"))
    return (
        pairs.join(a, ["owner_id", "ancestor"], "left")
        .join(c, ["owner_id", "candidate"], "left")
        .withColumn("is_descendant", F.coalesce(inside, F.lit(False)))
        .drop("_a", "_n", "_c")
    )


def child_pages(nodes: DataFrame, *, page_rows: int = 1000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ordered children of each parent, in pages of at most ``page_rows``.

    The rows with a null id list the owner's roots.
    """
    live = live_nodes(nodes).select("owner_id", "id", "parent_id", "sort_order", "name")
    ranked = rank_rows(live, ["owner_id", "parent_id"], display_order(), "_rank", hot_rows=hot_rows)
    page = F.floor((F.col("_rank") - 1) / page_rows).cast("bigint")
    entry = F.struct("_rank", "id", "name", "sort_order")
    children = F.transform(
        F.sort_array(F.collect_list(entry)),
        lambda e: F.struct(e["id"].alias("id"), e["name"].alias("name"), e["sort_order"].alias("sort_order")),
    )
    return (
        ranked.withColumn("page", page)
        .groupBy("owner_id", F.col("parent_id").alias("id"), "page")
        .agg(children.alias("children"))
    )


def node_context(nodes: DataFrame, *, page_rows: int = 1000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each live node with its path and its children, one row per page of children."""
    pages = child_pages(nodes.where(F.col("parent_id").isNotNull()), page_rows=page_rows, hot_rows=hot_rows)
    paths = ancestor_path(nodes).select("id", "path")
    view = live_nodes(nodes).select("owner_id", "id", "name", "parent_id", "sort_order")
    return (
        view.join(paths, "id")
        .join(pages, ["owner_id", "id"], "left")
        .withColumn("page", F.coalesce("page", F.lit(0).cast("bigint")))
    )


def root_context(nodes: DataFrame, *, page_rows: int = 1000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What an owner sees above all nodes: the roots, in pages."""
    roots = live_nodes(nodes).where(F.col("parent_id").isNull())
    return child_pages(roots, page_rows=page_rows, hot_rows=hot_rows).drop("id")


def subtree_documents(
    nodes: DataFrame, order: DataFrame, render: Column, *, separator: str, part_chars: int = PART_CHARS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Text of every node and its descendants in display order, joined by ``separator``, in parts of at most ``part_chars`` characters.

    Parts are numbered from 0 and put together, with nothing between, they are the exact text; a cut may fall inside a
    node's text.  ``n_nodes`` counts the nodes whose text begins in the part.  ``order`` is the result of
    :func:`preorder_rows`, ``render`` the text of one node; a node whose text is null adds neither text nor separator.

    Running totals of lengths in display order give every node's offset below any ancestor, so only narrow rows are
    packed, and texts join once their places are known.
    """
    gap = len(separator)
    texts = live_nodes(nodes).select("owner_id", F.col("id").alias("_member"), render.alias("_text"))
    lengths = texts.select("owner_id", F.col("_member").alias("id"), F.coalesce(F.length("_text") + gap, F.lit(0)).cast("bigint").alias("_n"))
    sized = order.select("owner_id", "id", "pos", "subtree_size").join(lengths, ["owner_id", "id"])
    summed = kept(running_sums(sized, ["owner_id"], [F.col("pos")], {"_through": F.col("_n")}, hot_rows=hot_rows), "text-offsets")
    ends = summed.select("owner_id", (F.col("pos") + 1).alias("_to"), F.col("_through").alias("_end"))
    spans = summed.select(
        "owner_id", "id", F.col("pos").alias("_from"), (F.col("pos") + F.col("subtree_size")).alias("_to"), (F.col("_through") - F.col("_n")).alias("_start")
    ).join(ends, ["owner_id", "_to"])
    spans = spans.withColumn("_whole", F.greatest(F.col("_end") - F.col("_start") - gap, F.lit(0)))
    before = summed.select("owner_id", F.col("id").alias("_member"), (F.col("_through") - F.col("_n")).alias("_before"), "_n")
    rows = _within(spans, summed).join(before, ["owner_id", "_member"])
    rows = rows.withColumn("_at", F.col("_before") - F.col("_start"))
    last = F.greatest(F.col("_whole") - 1, F.lit(0))
    first_part = F.floor(F.least(F.col("_at"), last) / part_chars)
    last_part = F.greatest(first_part, F.floor(F.least(F.col("_at") + F.col("_n") - 1, last) / part_chars))
    rows = rows.select("owner_id", "id", "_member", "_pos", "_at", "_whole", first_part.alias("_first"), F.explode(F.sequence(first_part, last_part)).alias("part"))
    low = F.greatest(F.col("_at"), F.col("part") * part_chars)
    high = F.least(F.col("_whole"), (F.col("part") + 1) * part_chars)
    piece = F.concat(F.col("_text"), F.lit(separator)).substr((low - F.col("_at") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    pieces = rows.join(texts, ["owner_id", "_member"]).select(
        "owner_id", "id", "part", "_pos", F.coalesce(piece, F.lit("")).alias("_piece"), (F.col("_first") == F.col("part")).alias("_begins")
    )
    ordered = F.sort_array(F.collect_list(F.struct("_pos", "_piece")))
    return pieces.groupBy("owner_id", "id", "part").agg(
        F.array_join(F.transform(ordered, lambda r: r["_piece"]), "").alias("text"), F.count_if("_begins").alias("n_nodes")
    )


def derive_edges(nodes: DataFrame) -> DataFrame:
    """Edges implied by the parent pointers of live, attached nodes."""
    linked = parent_link(nodes, carry=("sort_order",)).where(F.col("up").isNotNull())
    return linked.select(
        F.col("up").alias("parent_id"), F.col("id").alias("child_id"), "sort_order",
        F.lit("parent-child").alias("relationship_type"),
    )


def edge_drift(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges missing from, or extra in, the stored edge table."""
    names = ["parent_id", "child_id", "sort_order"]
    derived, stored = derive_edges(nodes).select(*names), edges.select(*names)
    missing = derived.exceptAll(stored).withColumn("drift", F.lit("missing"))
    return missing.unionByName(stored.exceptAll(derived).withColumn("drift", F.lit("extra")))


def inherit_root_fields(nodes: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Every live node with columns of its root, renamed by ``fields``."""
    roots = live_nodes(nodes).select(F.col("id").alias("root_id"), *[F.col(c).alias(a) for c, a in fields.items()])
    return tree_root(nodes).where(F.col("root_id").isNotNull()).join(roots, "root_id", "left")


def children_in_order(nodes: DataFrame) -> DataFrame:
    """Live nodes sorted by owner, parent and display order."""
    return live_nodes(nodes).orderBy("owner_id", F.col("parent_id").asc_nulls_first(), *display_order())


def page_of_children(nodes: DataFrame, offset: int, limit: int, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Children ``offset`` .. ``offset + limit`` of every parent."""
    ranked = sibling_rank(nodes, hot_rows=hot_rows)
    return ranked.where((F.col("position") > offset) & (F.col("position") <= offset + limit))


