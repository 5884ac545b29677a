from datetime import datetime
import random

import pytest
from pyspark.sql import functions as F

from grovekeep.functions.fixed_values import DUPLICATE_NAME_SUFFIX as SUFFIX
from grovekeep.operators import hierarchy as H
from grovekeep.operators import restructure as S
from grovekeep.operators import scans


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def moves_of(spark, *pairs, owner="o"):
    return spark.createDataFrame([(i, owner, n, p) for i, (n, p) in enumerate(pairs)], "seq long, owner_id string, id long, new_parent_id long")


def reasons(rejects):
    return {r.seq: r.reason for r in rejects.collect()}


def parents(nodes):
    return {r.id: r.parent_id for r in nodes.where("not is_deleted").collect()}


def test_moves_are_checked(spark, forest):
    nodes = forest((1, None), (2, 1), (3, 2), (4, None, {"name": "n3"}), (5, None, {"is_deleted": True}), (6, None))
    moves = moves_of(spark, (1, 3), (1, 4), (3, 1), (4, 2), (6, 5), (2, 1), (9, 1), (6, 2))
    after, rejects = S.apply_moves(nodes, moves)
    assert reasons(rejects) == {0: "own_descendant", 1: "moved_twice", 3: "name_taken", 4: "parent_not_found", 5: "no_op",
                                6: "node_not_found", 7: "moved_twice"}
    assert parents(after) == {1: None, 2: 1, 3: 1, 4: None, 6: None}


def test_a_node_cannot_be_its_own_parent(spark, forest):
    after, rejects = S.apply_moves(forest((1, None), (2, 1)), moves_of(spark, (2, 2)))
    assert reasons(rejects) == {0: "own_descendant"} and parents(after) == {1: None, 2: 1}


def test_moves_that_jointly_close_a_cycle_are_rejected(spark, forest):
    nodes = forest((1, None), (2, 1), (3, None), (4, 3), (5, None))
    after, rejects = S.apply_moves(nodes, moves_of(spark, (1, 4), (3, 2), (5, 4)))
    assert reasons(rejects) == {0: "joint_cycle", 1: "joint_cycle"}
    assert parents(after) == {1: None, 2: 1, 3: None, 4: 3, 5: 4}


def test_arrivals_are_appended_and_share_no_name(spark, forest):
    nodes = forest((1, None), (2, 1, {"sort_order": 7.0}), (3, None, {"name": "a"}), (4, None, {"name": "a"}), (5, None))
    after, rejects = S.apply_moves(nodes, moves_of(spark, (5, 1), (4, 1), (3, 1)))
    assert reasons(rejects) == {2: "name_taken_in_batch"}
    assert {r.id: r.sort_order for r in after.where("parent_id = 1").collect()} == {2: 7.0, 5: 8.0, 4: 9.0}


def test_random_moves_leave_a_forest(spark, forest):
    rng = random.Random(11)
    nodes = forest(*[(i, rng.randrange(i) if i and rng.random() < 0.8 else None) for i in range(40)])
    moves = moves_of(spark, *[(i, rng.randrange(40)) for i in range(0, 40, 2)])
    after, rejects = S.apply_moves(nodes, moves)
    assert H.node_depth(after).where("in_cycle").count() == 0
    refused = {r.id for r in rejects.collect()}
    wanted = {r.id: r.new_parent_id for r in moves.collect()}
    old, new = parents(nodes), parents(after)
    assert all(new[i] == (old[i] if i in refused or i not in wanted else wanted[i]) for i in new)


def test_promote_delete_climbs_chains(spark, forest):
    nodes = forest((1, None), (2, 1), (3, 2), (4, 3), (5, 3), (6, 1), (7, 99), (8, 7), (9, None), (10, 9))
    gone = spark.createDataFrame([("o", 2), ("o", 3), ("o", 7), ("o", 9), ("o", 77)], "owner_id string, id long")
    for hot_rows in (1, 1000):
        after, rejects = S.apply_promote_delete(nodes, gone, hot_rows=hot_rows)
        assert parents(after) == {1: None, 4: 1, 5: 1, 6: 1, 8: 99, 10: None}
        assert [r.id for r in after.where("parent_id = 1 and not is_deleted").orderBy("sort_order").collect()] == [6, 4, 5]
        assert [r.reason for r in rejects.collect()] == ["node_not_found"]


def test_cascade_delete(spark, forest):
    nodes = forest((1, None), (2, 1), (3, 2), (4, None), (5, 4, {"is_deleted": True}), (6, 5))
    after, _ = S.apply_cascade_delete(nodes, spark.createDataFrame([("o", 2), ("o", 4)], "owner_id string, id long"))
    assert parents(after) == {1: None, 6: 5}


def test_creates(spark, forest):
    nodes = forest((1, None), (2, 1, {"name": "a", "sort_order": 3.0}))
    asked = [(1, 11, 1, " a "), (2, 12, 1, "b"), (3, 13, 1, "b"), (4, 14, 1, "\t\n"), (5, 15, None, "n1"), (6, 16, 1, "c")]
    creates = spark.createDataFrame([(s, i, "o", p, n) for s, i, p, n in asked], "seq long, id long, owner_id string, parent_id long, name string")
    made, rejects = S.apply_creates(nodes, creates)
    assert reasons(rejects) == {1: "name_taken", 3: "name_taken_in_batch", 4: "empty_name"}
    assert rows(made, "id", "sort_order") == [(12, 4.0), (15, 1.0), (16, 5.0)]
    _, strict = S.apply_creates(nodes, creates, enforce_root=True)
    assert reasons(strict)[5] == "name_taken"


def test_content_updates_keep_the_last_write(spark, forest):
    nodes = forest((1, None), (2, None, {"is_deleted": True}))
    at = datetime(2024, 1, 1)
    updates = spark.createDataFrame([(1, "o", 1, "x", at), (2, "o", 1, "y", at), (3, "o", 2, "z", at)],
                                    "seq long, owner_id string, id long, content string, at timestamp")
    after, rejects = S.apply_content_updates(nodes, updates)
    assert rows(after, "id", "content") == [(1, "y"), (2, "")]
    assert reasons(rejects) == {3: "node_not_found"}


def test_next_order_can_leave_siblings_out(spark, forest):
    nodes = forest((1, None, {"sort_order": 5.0}), (2, None, {"sort_order": 2.0}))
    assert S.next_sort_order(nodes).first().next_order == 6.0
    assert S.next_sort_order(nodes, nodes.where("id = 1")).first().next_order == 3.0


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_name_clashes_get_a_suffix_once(spark, forest, hot_rows):
    nodes = forest((1, None, {"name": "Math"}), (2, 1, {"name": "a"}), (3, 1, {"name": "b"}), (4, 1, {"name": "b" + SUFFIX}))
    asked = [(1, "a", "math"), (2, "a", "MATH"), (3, "b", "Math"), (4, "c", "Math"), (5, "c", "math"), (6, "c", "math"), (7, "x", ""),
             (8, "p", "Poetry"), (9, "q", "poetry"), (10, "c" + SUFFIX, "math")]
    suggestions = spark.createDataFrame([(s, "o", n, "text", p) for s, n, p in asked],
                                        "seq long, owner_id string, name string, content string, suggested_parent string")
    made, skipped = S.place_generated_nodes(nodes, suggestions, hot_rows=hot_rows)
    placed = rows(made.where("not is_new_root"), "seq", "name")
    assert placed == sorted([(1, "a" + SUFFIX), (4, "c"), (5, "c" + SUFFIX), (7, "x"), (8, "p"), (9, "q")], key=repr)
    assert rows(made.where("is_new_root"), "name", "parent_id") == [("Poetry", None)]
    assert rows(skipped, "seq", "reason") == sorted([(2, "name_taken_twice"), (3, "name_taken_twice"), (6, "name_taken_twice"),
                                                     (10, "name_taken_twice")], key=repr)
    root = made.where("is_new_root").first().id
    assert {r.parent_id for r in made.where("seq in (8, 9) and not is_new_root").collect()} == {root}
    assert S.placement_summary(made, skipped).first()[1:] == (7, 4)


def test_responses_see_what_they_have_made(spark, forest):
    nodes = forest((1, None, {"name": "Math"}), (2, 1, {"name": "Algebra"}), (3, 2, {"name": "Rings"}))
    asked = [
        (1, 1, "Groups", "algebra"), (2, 1, "Lie groups", "groups"), (3, 1, "SU(2)", "Lie groups"), (4, 1, "Verse", "Poetry"), (5, 1, "Ode", "poetry"),
        (6, 1, "Odes", "Ode"), (7, 2, "Sonnet", "POETRY"), (8, 2, "x", "Groups"), (9, 2, "Groups", "Algebra"), (10, 3, "Groups", "algebra"),
        (11, 3, "Deep", "groups"), (12, 3, "Rings", "Math"), (13, 3, "y", "rings"), (14, 3, None, "Math"), (15, 3, "z", None), (16, 3, "w", ""),
    ]
    columns = "seq long, response_id int, name string, suggested_parent string"
    suggestions = spark.createDataFrame(asked, columns).withColumns({"owner_id": F.lit("o"), "content": F.lit("")})
    made, skipped = S.place_generated_nodes(nodes, suggestions)
    made = made.collect()
    names = {r.id: r.name for r in made} | {1: "Math", 2: "Algebra", 3: "Rings"}
    # The root "Groups" is a new one, which response 2 makes as its snapshot has no such node.
    assert sorted((r.seq, r.name, names.get(r.parent_id)) for r in made if not r.is_new_root) == [
        (1, "Groups", "Algebra"), (2, "Lie groups", "Groups"), (3, "SU(2)", "Groups"), (4, "Verse", "Poetry"), (5, "Ode", "Poetry"), (6, "Odes", "Ode"),
        (7, "Sonnet", "Poetry"), (8, "x", "Groups"), (9, "Groups" + SUFFIX, "Algebra"), (12, "Rings", "Math"), (13, "y", "Rings"), (16, "w", "Math")]
    assert sorted((r.name, r.seq) for r in made if r.is_new_root) == [("Groups", 8), ("Poetry", 4)]
    assert rows(skipped, "seq", "reason") == sorted([(10, "name_taken_twice"), (11, "parent_skipped"), (14, "no_name"), (15, "no_parent_name")], key=repr)


def test_upsert_and_insert_ignore(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    changes = spark.createDataFrame([(2, "c", None)], "id int, x string, y int")
    assert rows(scans.upsert_by_key(target, changes, ["id"]), "id", "x", "y") == [(1, "a", 1), (2, "c", 2)]
    incoming = spark.createDataFrame([(2, "z", 0), (3, "p", 2), (3, "q", 1)], "id int, x string, y int")
    assert rows(scans.insert_ignore(target, incoming, ["id"], ["y"]), "id", "x") == [(3, "q")]


def test_cascade_follows_cycles(spark, forest):
    nodes = forest((1, 6), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 4), (8, None), (9, 8), (10, 10))
    deletes = spark.createDataFrame([(1, "o", 1)], "seq int, owner_id string, id long")
    after, _ = S.apply_cascade_delete(nodes, deletes)
    assert sorted(r.id for r in after.where("is_deleted").collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_the_last_of_repeated_changes_counts(spark):
    target = spark.createDataFrame([(1, "a", 1)], "id int, x string, y int")
    changes = spark.createDataFrame([(1, "b", 5, 1), (1, "c", 4, 2)], "id int, x string, y int, at int")
    got = scans.upsert_by_key(target, changes, ["id"], ["at"]).collect()
    assert [tuple(r) for r in got] == [(1, "c", 4)]


def test_placed_nodes_come_after_deleted_siblings(spark, forest):
    nodes = forest((1, None, {"name": "Biology"}), (2, 1, {"sort_order": 0.0}), (3, 1, {"sort_order": 7.0, "is_deleted": True}), (4, None, {"sort_order": 4.0, "is_deleted": True}))
    suggestions = spark.createDataFrame(
        [(1, "o", "Cells", "", "biology"), (2, "o", "Atoms", "", "Chemistry")],
        "seq long, owner_id string, name string, content string, suggested_parent string",
    )
    made, _ = S.place_generated_nodes(nodes, suggestions)
    assert rows(made, "name", "sort_order") == [("Atoms", 0.0), ("Cells", 8.0), ("Chemistry", 5.0)]
    extracted = spark.createDataFrame([(1, "o", 1, "Genes", "")], "seq long, owner_id string, parent_id long, name string, content string")
    assert rows(S.place_extracted_nodes(nodes, extracted)[0], "name", "sort_order") == [("Genes", 8.0)]
