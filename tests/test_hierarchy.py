import random

import pytest
from pyspark.sql import functions as F

from grovekeep import scratch
from grovekeep.operators import forest as forests
from grovekeep.operators import hierarchy as H
from grovekeep.operators import keyed, recall


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def random_forest(rng, n, owner_size=10**6):
    """(id, parent) pairs in which parents come anywhere, with some missing."""
    out = []
    for i in range(n):
        parent = None if i == 0 or rng.random() < 0.1 else rng.randrange(i)
        out.append((i, parent, {"sort_order": float(rng.randrange(3)), "name": f"m{rng.randrange(4)}", "is_deleted": rng.random() < 0.1}))
    return out


class Brute:
    """Forest facts by plain recursion, to check against."""

    def __init__(self, spec):
        self.live = {i: (p, e) for i, p, e in spec if not e["is_deleted"]}
        self.kids = {}
        for i, (p, _) in self.live.items():
            self.kids.setdefault(p if p in self.live else None, []).append(i)
        for k in self.kids.values():
            k.sort(key=lambda i: (self.live[i][1]["sort_order"], self.live[i][1]["name"], i))

    def depth(self, i):
        p = self.live[i][0]
        return 1 + self.depth(p) if p in self.live else 0

    def below(self, i):
        return [d for c in self.kids.get(i, []) for d in [c, *self.below(c)]]

    def height(self, i):
        return max([1 + self.height(c) for c in self.kids.get(i, [])], default=0)

    def leaves(self, i):
        return sum(self.leaves(c) for c in self.kids.get(i, [])) or 1

    def preorder(self):
        return [d for r in self.kids.get(None, []) for d in [r, *self.below(r)]]


@pytest.mark.parametrize("seed,hot_rows", [(1, 10**6), (2, 1), (3, 3)])
def test_random_forests(spark, forest, seed, hot_rows):
    spec = random_forest(random.Random(seed), 80)
    nodes, brute = forest(*spec), Brute(spec)
    shape = rows(H.subtree_shape(nodes), "id", "depth", "subtree_size", "height", "leaves")
    assert shape == sorted((i, brute.depth(i), 1 + len(brute.below(i)), brute.height(i), brute.leaves(i)) for i in brute.live)
    order = H.preorder_rows(nodes, hot_rows=hot_rows)
    assert [i for _, i in rows(order, "pos", "id")] == brute.preorder()
    assert [r.pos for r in order.orderBy("pos").collect()] == list(range(len(brute.live)))
    assert [i for _, i in rows(order, "path_key", "id")] == brute.preorder()
    pairs = rows(H.descendant_closure(nodes), "ancestor", "descendant")
    assert pairs == sorted((i, d) for i in brute.live for d in brute.below(i))


def test_deep_chain_needs_few_rounds(spark, forest, monkeypatch):
    n, calls, write = 300, [], scratch.Rounds.write
    monkeypatch.setattr(scratch.Rounds, "write", lambda *a, **k: calls.append(1) or write(*a, **k))
    got = rows(H.node_depth(forest(*[(i, i - 1 if i else None) for i in range(n)])), "id", "depth")
    assert got == [(i, i) for i in range(n)]
    assert len(calls) <= 10


def test_cycles_are_reported(spark, forest):
    nodes = forest((1, 2), (2, 1), (3, 3), (4, 1), (5, None), (6, 5))
    assert rows(H.node_depth(nodes), "id", "depth", "in_cycle")[0:2] == [(1, None, True), (2, None, True)]
    assert rows(H.reachable_nodes(nodes), "id") == [(5,), (6,)]
    assert rows(H.cycle_nodes(nodes), "id") == [(1,), (2,), (3,), (4,)]
    assert rows(H.preorder_rows(nodes), "pos", "id") == [(0, 5), (1, 6)]
    paths = dict(rows(H.ancestor_path(nodes), "id", "path"))
    assert paths == {1: [2, 1], 2: [1, 2], 3: [3], 4: [2, 1, 4], 5: [5], 6: [5, 6]}


def test_orphans(spark, forest):
    nodes = forest((1, None), (2, 1, {"is_deleted": True}), (3, 2), (4, 3), (5, 99))
    assert rows(H.node_depth(nodes), "id", "depth") == [(1, 0), (3, 0), (4, 1), (5, 0)]
    assert rows(H.orphan_nodes(nodes), "id") == [(3,), (5,)]
    assert rows(H.preorder_rows(nodes, orphans="drop"), "id") == [(1,)]
    assert dict(rows(H.ancestor_path(nodes), "id", "path"))[4] == [1, 2, 3, 4]
    assert dict(rows(H.ancestor_path(nodes, exclude_self=True), "id", "path"))[4] == [1, 2, 3]


def test_parent_of_another_owner_does_not_count(spark, forest):
    nodes = forest((1, None), owner="a").unionByName(forest((2, 1), owner="b"))
    assert rows(H.parent_link(nodes), "id", "up", "is_orphan") == [(1, None, False), (2, None, True)]


def test_blocked_move_targets(spark, forest):
    nodes = forest((1, None), (2, 1), (3, 1), (4, 3), (5, None))
    moving = nodes.where("id = 1")
    assert rows(H.blocked_move_targets(moving, H.preorder_rows(nodes), nodes), "blocked_id") == [(1,), (2,), (3,), (4,)]


def test_blocked_move_targets_of_wide_and_cyclic_nodes(spark, forest):
    """Spans over several bins; a node on a cycle blocks itself; no closure in the plan."""
    nodes = forest((0, None), *[(i, i // 2) for i in range(1, 900)], (1000, 1001), (1001, 1000), (1002, None, {"is_deleted": True}))
    nodes = nodes.withColumn("parent_id", F.when(F.col("id") == 1, 0).otherwise(F.col("parent_id")))
    moving = nodes.where("id in (1, 3, 450, 1000, 1002)")
    below = {i: {j for j in range(1, 900) if any(j >> k == i for k in range(10))} for i in (1, 3, 450)}
    want = sorted([(i, j) for i, found in below.items() for j in found] + [(1000, 1000)])
    assert rows(H.blocked_move_targets(moving, H.preorder_rows(nodes), nodes), "id", "blocked_id") == want


def test_child_pages_cover_all_children(spark, forest):
    nodes = forest((0, None), *[(i, 0) for i in range(1, 24)])
    pages = H.child_pages(nodes, page_rows=10, hot_rows=5).where("id = 0").orderBy("page").collect()
    assert [c.id for c in H.root_context(nodes).first().children] == [0]
    assert [len(p.children) for p in pages] == [10, 10, 3]
    assert [c.id for p in pages for c in p.children] == list(range(1, 24))


def test_subtree_documents_in_parts(spark, forest):
    nodes = forest((1, None), (2, 1), (3, 2), (4, 1))
    docs = H.subtree_documents(nodes, H.preorder_rows(nodes), F.col("name"), separator=",", part_chars=7)
    assert rows(docs.where("id = 1"), "part", "text", "n_nodes") == [(0, "n1,n2,n", 3), (1, "3,n4", 1)]


@pytest.mark.parametrize("part_chars, separator", [(1, ""), (5, ", "), (1000, ", ")])
def test_subtree_documents_join_to_the_text(spark, forest, separator, part_chars):
    texts = {1: "ab", 2: None, 3: "", 4: "é𝄞" * 5, 5: None, 6: None, 7: "z"}
    parents = {1: None, 2: 1, 3: 2, 4: 2, 5: 1, 6: 5, 7: 1}
    nodes = forest(*[(i, p, {"content": texts[i]}) for i, p in parents.items()])
    docs = H.subtree_documents(nodes, H.preorder_rows(nodes), F.col("content"), separator=separator, part_chars=part_chars, hot_rows=2).collect()

    def below(i):
        return [i, *[k for j, p in parents.items() if p == i for k in below(j)]]

    for i in parents:
        mine = sorted((r.part, r.text, r.n_nodes) for r in docs if r.id == i)
        assert [p for p, _, _ in mine] == list(range(len(mine)))
        assert "".join(t for _, t, _ in mine) == separator.join(texts[j] for j in below(i) if texts[j] is not None)
        assert all(len(t) <= part_chars for _, t, _ in mine)
        assert sum(n for _, _, n in mine) == len(below(i))


@pytest.mark.parametrize("hot_rows", [1, 4, 1000])
def test_running_sums_do_not_depend_on_the_cut(spark, hot_rows):
    rng = random.Random(5)
    data = [(k, i, rng.randrange(100)) for k in [None, "a", "b"] for i in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(data, "k string, i int, v int")
    got = keyed.running_sums(df, ["k"], [F.col("i")], {"s": F.col("v"), "n": F.lit(1)}, hot_rows=hot_rows)
    want = sorted(((k or "", i, sum(v2 for k2, i2, v2 in data if k2 == k and i2 <= i), i + 1) for k, i, v in data))
    assert sorted((r.k or "", r.i, r.s, r.n) for r in got.collect()) == want


def test_forest_health_of_known_forests(spark, forest):
    def stats(nodes):
        s = nodes
        for name, value in {"stability": 0.0, "difficulty": 0.3, "review_count": 0, "mastery": 0.0}.items():
            s = s.withColumn(name, F.lit(value))
        s = s.withColumn("review_state", F.lit("new"))
        shape = H.subtree_shape(s, carry=("parent_id",))
        roots = forests.root_stats(shape, s)
        return roots, shape

    roots, shape = stats(forest(*[(i, None) for i in range(5)]))
    assert forests.shape_ratios(roots, shape).first().width_depth_ratio == 5
    health = forests.forest_health(roots, shape).first()
    assert (health.growth_multiplier, health.total_nodes, health.avg_stability) == (0.3, 5, 0.0)
    roots, shape = stats(forest((1, None), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, None)))
    assert rows(roots, "id", "subtree_size", "height") == [(1, 6, 2), (7, 1, 0)]
    assert forests.shape_ratios(roots, shape).first().max_subtree_ratio == pytest.approx(6 / 7)
    spans = forests.proportional_ranges(roots, forests.forest_health(roots, shape), hot_rows=1).orderBy("id").collect()
    assert spans[0].angle_end == pytest.approx(spans[1].angle_start) and spans[1].angle_end == pytest.approx(3.14159265, abs=1e-6)
    assert spans[0].quota > spans[1].quota == 3
    roots, shape = stats(forest((2, 99), (3, 2)))
    assert rows(roots, "id", "descendants") == [(2, 1)]


def test_leaf_weights(spark, forest):
    got = dict((r.id, (r.leaves, r.weight)) for r in H.leaf_weights(H.subtree_shape(forest((1, None), (2, 1), (3, 1)))).collect())
    assert got == {1: (2, 8.0), 2: (1, 1.0), 3: (1, 1.0)}


def test_learner_statistics_of_an_empty_log(spark):
    stats = spark.createDataFrame([], "owner_id string, id long, mastery_score double, stability double, review_count long")
    assert recall.learner_kpis(stats).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_walks_on_cycles_by_brute_force(spark, seed):
    """Any pointers, cycles included: who meets a marked row, and who is on a cycle."""
    rng = random.Random(seed)
    n = 60
    up = {i: rng.randrange(n) if rng.random() < 0.95 else None for i in range(n)}
    # One long cycle with a tail as long, whose only mark is far away.
    up.update({i: n + (i - n + 1) % 40 for i in range(n, n + 40)} | {i: i - 1 for i in range(n + 40, n + 80)})
    marked = {i for i in range(n) if rng.random() < 0.05} | {n + 20}

    def walk(i):
        seen = []
        while i is not None and i not in seen:
            seen.append(i)
            i = up[i]
        return seen, i

    links = spark.createDataFrame([(i, p, i in marked) for i, p in up.items()], "id long, up long, marked boolean")
    assert {r.id for r in H.below_marked(links).collect()} == {i for i in up if marked & set(walk(i)[0])}
    assert {r.id for r in H.cycle_members(links).collect()} == {i for i in up if walk(i)[1] == i}


def test_walks_without_rows_or_marks(spark):
    none = spark.createDataFrame([], "id long, up long, marked boolean")
    assert H.below_marked(none).count() == 0 and H.cycle_members(none).count() == 0
    loop = spark.createDataFrame([(1, 2, False), (2, 1, False), (3, 3, False), (4, 3, False), (5, None, False)], none.schema)
    assert H.below_marked(loop).count() == 0
    assert rows(H.cycle_members(loop), "id") == [(1,), (2,), (3,)]


def test_slices_do_not_grow_with_a_small_threshold(spark):
    """Groups that count as hot from a few rows on are cut into as many slices as there are tasks, not rows."""
    rows = spark.range(3000).select(F.lit("o").alias("owner_id"), "id")
    cut = keyed.sliced(rows, ["owner_id"], [F.col("id")], 3000, 10)
    assert cut.select("_slice").distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = keyed.running_sums(rows, ["owner_id"], [F.col("id")], {"total": F.col("id")}, hot_rows=10).collect()
    assert all(r.total == r.id * (r.id + 1) // 2 for r in sums)
