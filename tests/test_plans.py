"""The plans that matter at scale: pushdown, pruning, limits before shuffles, no pair joins."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from grovekeep.operators import hierarchy, questions, recall, scans
from grovekeep.sources import fixtures, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(f"n{i}", "o", f"name{i}", "text", f"n{i // 3}" if i else None, float(i)) for i in range(30)]
    bare = spark.createDataFrame(rows, "id string, owner_id string, name string, content string, parent_id string, sort_order double")
    full = scans.evolve_schema(bare, {**tables.NODE_DEFAULTS, "is_deleted": ("boolean", False), "domain_tag": ("string", None),
                                      "created_at": ("timestamp", None), "updated_at": ("timestamp", None)})
    columns = [c.split()[0] for c in tables.NODES.split(", ")]
    tables.write_table(full.select(*columns), path, "nodes")
    full.select(*columns).write.json(f"{path}/nodes_json")
    return path


def test_filters_and_columns_reach_the_scan(spark, folder):
    nodes = tables.read_table(spark, folder, "nodes")
    text = plan(scans.scan_nodes(nodes, ["id", "name"]))
    assert "EqualTo(is_deleted,false)" in text or "Not(EqualTo(is_deleted,true))" in text
    assert "ReadSchema: struct<id:string,name:string,is_deleted:boolean>" in text
    day = F.lit(datetime(2024, 1, 31)).cast("timestamp")
    assert "GreaterThanOrEqual(last_review_at" in plan(recall.reviewed_on_day(nodes, day))
    assert "content" not in plan(hierarchy.parent_link(nodes))


def test_json_and_parquet_tables_agree(spark, folder):
    stored = tables.read_table(spark, folder, "nodes")
    as_json = tables.read_json_table(spark, folder, "nodes_json", schema=tables.NODES)
    assert sorted(map(tuple, stored.select("id", "parent_id", "difficulty").collect())) == sorted(
        map(tuple, as_json.select("id", "parent_id", "difficulty").collect()))


def test_top_k_is_cut_before_the_shuffle(spark, folder):
    nodes = tables.read_table(spark, folder, "nodes")
    text = plan(recall.due_queue(nodes, F.lit(datetime(2024, 1, 31)).cast("timestamp")))
    assert "row_number(), 20, Partial" in text and "content" not in text


def test_latest_attempt_combines_before_the_shuffle(spark, sf):
    assert "partial_max(" in plan(entry_points.queries()["latest_per_key"](spark, sf))


@pytest.mark.parametrize("name", ["match_parent", "keyword_match", "question_latest_attempt", "wrong_questions", "move_conflicts",
                                  "quiz_node_stats", "owned_events", "dominant_style", "edge_drift", "sibling_conflicts"])
def test_no_pair_joins(spark, sf, name):
    text = plan(entry_points.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_a_hot_parent_is_split(spark, monkeypatch):
    """Nearly all lookups go to one parent; AQE splits that partition and the depths stay right."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        i = F.col("id")
        up = F.when(i % 100 == 0, None).when(i % 4 == 1, i - i % 100).otherwise(F.lit(0))
        nodes = spark.range(0, 40000, 1, 8).select(
            "id", F.lit("o").alias("owner_id"), up.cast("long").alias("parent_id"), F.lit(False).alias("is_deleted"))
        linked = hierarchy.parent_link(nodes)
        linked.write.format("noop").mode("overwrite").save()
        linked.collect()
        assert "skew=true" in plan(linked)
        got = {r.depth: r.n for r in hierarchy.node_depth(nodes).groupBy("depth").agg(F.count("*").alias("n")).collect()}
        assert got == {0: 400, 1: 39600}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_scratch_needs_a_shared_folder_off_local_mode(spark, monkeypatch):
    from grovekeep import scratch

    class Context:
        master, applicationId = "yarn", "x"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        scratch.scratch_root(Session())
    Session.conf.get = staticmethod(lambda key, default=None: "/shared/folder/")
    assert scratch.scratch_root(Session()) == "/shared/folder"


def test_bucketed_reviews_fold_without_a_shuffle(spark, sf, tmp_path):
    log = fixtures.reviews(spark, sf)
    stored = tables.save_bucketed(log, "bucketed_reviews", tables.BUCKET_KEYS["reviews"], 4, path=str(tmp_path / "b"))
    try:
        folded = recall.recall_state_fold(stored)
        assert "Exchange" not in plan(folded) and "Exchange" in plan(recall.recall_state_fold(log))
        assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, recall.recall_state_fold(log).collect()))
    finally:
        spark.sql("DROP TABLE bucketed_reviews")


def test_json_arrays_are_read_one_per_file(spark, tmp_path):
    for name, text in {"a": '[{"id":"x","name":"n"},\n{"id":"y","name":"m"}]', "b": "broken"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows, rejects = scans.ingest_json_records(tables.read_json_arrays(spark, str(tmp_path)))
    assert sorted(r.id for r in rows.collect()) == ["x", "y"] and rejects.count() == 1


def test_option_shapes(spark):
    df = spark.createDataFrame([('["a","b"]',), ('{"reference_answer":"r","keywords":["k"]}',), ("oops",), (None,)], "o string")
    got = [tuple(r[0]) for r in df.select(questions.decode_options(F.col("o"))).collect()]
    assert got == [(["a", "b"], None, None, None), (None, "r", ["k"], None), (None, None, None, "oops"), (None, None, None, None)]
