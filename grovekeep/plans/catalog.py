"""Every operator as a query over the generic test tables.

Names follow the operator inventory.  Counts are bigint, times are text, and
arrays are joined into text so that the results compare with plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import recall as R
from ..functions import scalars as S
from ..functions.scalars import time_text
from ..operators import forest, generated, hierarchy, questions, recall, restructure, scans, tagging
from ..scratch import new_path
from ..sources import fixtures as X
from ..sources import tables
from ..streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def half_up(name: str) -> Column:
    return S.round_half_up(F.col(name), 6).alias(name)


def text(name: str) -> Column:
    return time_text(F.col(name)).alias(name)


def joined(name: str, separator: str = "/") -> Column:
    return F.array_join(F.transform(F.col(name), lambda x: x.cast("string")), separator).alias(name)


# --- scans, sources, sinks -------------------------------------------------------


@query
def scan_nodes(spark, d):
    return scans.scan_nodes(X.nodes(spark, d), ["owner_id", "id", "parent_id", "name"])


@query
def ingest_json_records(spark, d):
    rows, _ = scans.ingest_json_records(X.raw_node_arrays(spark, d))
    return rows.select("source", "id", "name", "content", "parent_id", "sort_order")


@query
def ingest_json_rejects(spark, d):
    _, rejects = scans.ingest_json_records(X.raw_node_arrays(spark, d))
    return rejects.select("source", "reason")


@query
def import_legacy_nodes(spark, d):
    return scans.import_legacy_nodes(X.legacy_nodes(spark, d)).withColumns({c: text(c) for c in ("created_at", "updated_at")})


@query
def import_legacy_edges(spark, d):
    return scans.import_legacy_edges(X.legacy_edges(spark, d))


@query
def import_legacy_records(spark, d):
    return scans.import_legacy_records(X.legacy_records(spark, d)).withColumn("answered_at", text("answered_at"))


def _order_lines(spark, d):
    rows = X.records(spark, d)
    return rows.select("order_key", "line", "question_id", "price")


@query
def insert_ignore(spark, d):
    rows = _order_lines(spark, d)
    target = X.records(spark, d).where("not is_correct").select("order_key", "line").distinct()
    order = ["question_id", "price"]
    return scans.insert_ignore(target, rows, ["order_key", "line"], order)


@query
def append_sink(spark, d):
    path = new_path(spark, "attempts")
    rows = X.records(spark, d).select("question_id", "owner_id", "is_correct")
    scans.append_sink(rows.where("is_correct"), path)
    scans.append_sink(rows.where("not is_correct"), path)
    stored = spark.read.schema(rows.schema).parquet(path)
    return stored.groupBy("owner_id", "is_correct").agg(F.count(F.lit(1)).alias("n"))


@query
def upsert_by_key(spark, d):
    states = X.states(spark, d)
    target = states.select("owner_id", "id", "name", "stability", "review_count")
    changes = states.where(F.col("review_state") == "relearning").select(
        "id", (F.col("stability") + 1).alias("stability"), F.when(F.col("stability") > 9, F.lit(9)).cast("bigint").alias("review_count")
    )
    return scans.upsert_by_key(target, changes, ["id"]).select("owner_id", "id", "name", r6("stability"), "review_count")


@query
def evolve_schema(spark, d):
    bare = X.nodes(spark, d).select("id", "owner_id")
    grown = scans.evolve_schema(bare, tables.NODE_DEFAULTS)
    return grown.select("id", "owner_id", "mastery_score", "depth", "stability", "difficulty", "review_count", "review_state",
                        text("last_review_at"))


@query
def import_report(spark, d):
    return scans.import_report(
        {"nodes": X.nodes(spark, d), "edges": X.edges(spark, d), "records": X.records(spark, d)}
    )


# --- projections, filters ----------------------------------------------------------


@query
def live_nodes(spark, d):
    return hierarchy.live_nodes(X.nodes(spark, d)).select("owner_id", "id", "name", "sort_order")


@query
def root_nodes(spark, d):
    return scans.root_nodes(X.nodes(spark, d)).select("owner_id", "id", "name")


@query
def node_view(spark, d):
    return scans.node_view(X.nodes(spark, d))


@query
def falsy_default(spark, d):
    s = X.states(spark, d)
    return s.select(
        "id",
        S.falsy_default(F.col("stability"), 0.0, T.DoubleType()).alias("stability"),
        S.falsy_default(F.col("difficulty"), 0.3, T.DoubleType()).alias("difficulty"),
        S.falsy_default(F.col("review_count"), 0, T.LongType()).cast("bigint").alias("review_count"),
        S.falsy_default(F.col("review_state"), "new", T.StringType()).alias("review_state"),
    )


@query
def null_safe_parent_match(spark, d):
    n = X.nodes(spark, d)
    wanted = n.where("is_deleted").select("owner_id", "parent_id").distinct()
    return scans.null_safe_parent_match(n.select("owner_id", "id", "parent_id"), wanted)


@query
def due_predicate(spark, d):
    return recall.due_nodes(X.states(spark, d), X.as_of()).select("owner_id", "id")


@query
def reviewed_on_day(spark, d):
    day = F.lit("2024-01-27 09:00:00").cast("timestamp")
    return recall.reviewed_on_day(X.states(spark, d), day).select("owner_id", "id", text("last_review_at"))


@query
def valid_rating(spark, d):
    ok, rejects = recall.valid_rating(X.node_reviews(spark, d))
    both = ok.withColumn("status", F.lit("ok")).unionByName(rejects.withColumn("status", F.lit("rejected")))
    return both.select("event_id", big("rating"), "status")


@query
def clean_names(spark, d):
    base = X.nodes(spark, d).select("id", F.when(F.pmod("id", F.lit(5)) == 0, F.lit(" \t\n")).otherwise(
        F.concat(F.lit("\t "), F.col("name"), F.lit(" x \n"))).alias("name"))
    ok, rejects = scans.clean_names(base)
    return ok.withColumn("status", F.lit("ok")).unionByName(rejects.withColumn("status", F.lit("empty")))


@query
def question_detail(spark, d):
    q = X.questions(spark, d)
    wanted = X.records(spark, d).where("not is_correct").select("owner_id", F.col("question_id").alias("id"))
    return questions.question_detail(q, wanted).select(
        "owner_id", "id", "node_id", "question", "options", big("correct_index"), "question_type", "difficulty", text("created_at")
    )


@query
def non_blank_content(spark, d):
    n = X.nodes(spark, d)
    blanked = n.withColumn("content", F.when(F.pmod("id", F.lit(4)) == 1, F.lit(" \n\t ")).otherwise(F.col("content")))
    return scans.non_blank_content(blanked).select("owner_id", "id")


# --- joins ---------------------------------------------------------------------------


@query
def parent_link(spark, d):
    return hierarchy.parent_link(X.nodes(spark, d)).select("owner_id", "id", "parent_id", "up", "is_orphan")


@query
def orphan_nodes(spark, d):
    return hierarchy.orphan_nodes(X.nodes(spark, d)).select("owner_id", "id", "parent_id")


@query
def owned_events(spark, d):
    ok, rejects = recall.owned_events(X.node_reviews(spark, d), X.nodes(spark, d))
    both = ok.withColumn("status", F.lit("ok")).unionByName(rejects.withColumn("status", F.lit("rejected")))
    return both.select("event_id", "owner_id", "node_id", "status")


@query
def missing_owners(spark, d):
    return scans.missing_owners(X.nodes(spark, d), X.users(spark, d))


@query
def owners_minus_users(spark, d):
    return scans.owners_minus_users(X.nodes(spark, d), X.users(spark, d))


@query
def question_latest_attempt(spark, d):
    rows = questions.question_latest_attempt(X.questions(spark, d), X.records(spark, d), ["order_key", "line", "price"])
    return rows.select("owner_id", "id", "node_id", "question", "question_type", "answered", "last_correct")


@query
def question_list(spark, d):
    rows = questions.question_list(X.questions(spark, d), X.records(spark, d), ["order_key", "line", "price"])
    return rows.select("owner_id", "node_id", "position", "id", "question", F.array_join("options.choices", ",").alias("choices"),
                       "options.reference_answer", F.array_join("options.keywords", ",").alias("keywords"), "options.raw", "explanation",
                       "question_type", "type_label", "difficulty", text("created_at"), "answered", "last_correct")


@query
def latest_per_key(spark, d):
    rows = questions.latest_attempts(X.records(spark, d), ["order_key", "line", "price"])
    return rows.select("owner_id", "question_id", "order_key", "line", "is_correct", text("answered_at"))


@query
def wrong_questions(spark, d):
    rows = questions.wrong_questions(X.questions(spark, d), X.records(spark, d))
    return rows.select("owner_id", "id", "question", text("last_wrong_at"), big("rank"))


@query
def question_counts(spark, d):
    return recall.question_counts(X.nodes(spark, d), X.questions(spark, d))


@query
def grade_answers(spark, d):
    graded = questions.grade_answers(X.records(spark, d), X.questions(spark, d))
    return graded.groupBy("owner_id", "question_type", "graded").agg(F.count(F.lit(1)).alias("n"))


@query
def sibling_conflicts(spark, d):
    n = X.nodes(spark, d)
    incoming = n.select((F.col("id") + 1000000).alias("seq"), "owner_id", "parent_id", F.concat(F.lit("n"), F.pmod("id", F.lit(3))).alias("name"))
    return restructure.sibling_conflicts(incoming, n)


@query
def sibling_name_clashes(spark, d):
    return restructure.sibling_name_clashes(X.nodes(spark, d))


@query
def match_parent(spark, d):
    return tagging.match_parent(X.suggestions(spark, d), X.named_nodes(spark, d))


@query
def keyword_match(spark, d):
    return tagging.keyword_match(X.taggable(spark, d), X.TAG_RULES)


@query
def keyword_match_table(spark, d):
    """As many rules as documents, over whole texts."""
    return tagging.keyword_hits(X.nodes(spark, d), X.keyword_rules(spark, d))


@query
def tag_nodes_by_table(spark, d):
    return tagging.tag_by_table(X.nodes(spark, d), X.keyword_rules(spark, d))


def _moves(spark, d) -> DataFrame:
    """Moves of the nodes labelled as good, to places near and far, some of them impossible."""
    n = F.col("id")
    target = (
        F.when(F.pmod(n, F.lit(4)) == 0, n + X.STRIDE * 3)
        .when(F.pmod(n, F.lit(4)) == 1, n - X.STRIDE)
        .when(F.pmod(n, F.lit(4)) == 2, n + X.STRIDE)
    )
    return X.labelled(spark, d, "quality", 1).select(n.alias("seq"), "owner_id", "id", target.alias("new_parent_id"))


@query
def move_conflicts(spark, d):
    n = X.nodes(spark, d)
    judged = restructure.move_conflicts(n, _moves(spark, d))
    return judged.select("owner_id", "id", "new_parent_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


# --- hierarchy -----------------------------------------------------------------------


@query
def node_depth(spark, d):
    return hierarchy.node_depth(X.nodes(spark, d)).select("owner_id", "id", "depth", "in_cycle")


@query
def node_depth_deep(spark, d):
    return hierarchy.node_depth(X.deep_nodes(spark, d)).select("owner_id", "id", "depth", "in_cycle")


@query
def node_depth_cyclic(spark, d):
    return hierarchy.node_depth(X.cyclic_nodes(spark, d)).select("owner_id", "id", "depth", "in_cycle")


@query
def tree_root(spark, d):
    return hierarchy.tree_root(X.nodes(spark, d))


@query
def ancestor_path(spark, d):
    return hierarchy.ancestor_path(X.nodes(spark, d)).select("owner_id", "id", joined("path"))


@query
def ancestor_path_cyclic(spark, d):
    return hierarchy.ancestor_path(X.cyclic_nodes(spark, d)).select("owner_id", "id", joined("path"))


@query
def descendant_closure(spark, d):
    return hierarchy.descendant_closure(X.nodes(spark, d))


@query
def is_descendant(spark, d):
    n = X.nodes(spark, d)
    live = hierarchy.live_nodes(n)
    pairs = live.select("owner_id", F.col("id").alias("candidate"), (F.pmod("id", F.lit(X.STRIDE)) + X.STRIDE * F.pmod("id", F.lit(7))).alias("ancestor"))
    return hierarchy.is_descendant(pairs, hierarchy.preorder_rows(n)).select("owner_id", "candidate", "ancestor", "is_descendant")


@query
def blocked_move_targets(spark, d):
    n = X.nodes(spark, d)
    moving = _moves(spark, d)
    return hierarchy.blocked_move_targets(moving, hierarchy.preorder_rows(n), n)


@query
def self_union_descendants(spark, d):
    n = X.nodes(spark, d)
    return hierarchy.self_union_descendants(hierarchy.descendant_closure(n), n)


@query
def child_count(spark, d):
    return hierarchy.child_count(X.nodes(spark, d))


@query
def subtree_size(spark, d):
    return hierarchy.subtree_shape(X.nodes(spark, d)).select("owner_id", "id", "subtree_size")


@query
def subtree_height(spark, d):
    return hierarchy.subtree_shape(X.deep_nodes(spark, d)).select("owner_id", "id", "height")


@query
def subtree_leaf_count(spark, d):
    shape = hierarchy.subtree_shape(X.nodes(spark, d))
    return hierarchy.leaf_weights(shape).select("owner_id", "id", "leaves", r6("weight"))


@query
def preorder_rows(spark, d):
    rows = hierarchy.preorder_rows(X.nodes(spark, d))
    return rows.select("owner_id", "id", "level", "pos", joined("path_key"))


@query
def reachable_nodes(spark, d):
    return hierarchy.reachable_nodes(X.cyclic_nodes(spark, d)).select("owner_id", "id", "depth")


@query
def node_context(spark, d):
    rows = hierarchy.node_context(X.nodes(spark, d))
    children = F.array_join(F.transform("children", lambda c: F.concat(c["id"].cast("string"), F.lit(":"), c["name"])), ",")
    return rows.select("owner_id", "id", "name", joined("path"), "page", F.coalesce(children, F.lit("")).alias("children"))


@query
def root_context(spark, d):
    rows = hierarchy.root_context(X.nodes(spark, d), page_rows=2)
    return rows.select("owner_id", "page", F.array_join(F.transform("children", lambda c: c["id"].cast("string")), ",").alias("children"))


@query
def subtree_documents(spark, d):
    n = X.nodes(spark, d)
    order = hierarchy.preorder_rows(n)
    rendered = F.concat(F.col("name"), F.lit("="), F.col("content"))
    docs = hierarchy.subtree_documents(n, order, rendered, separator="\n---\n")
    return docs.select("owner_id", "id", "part", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"), "n_nodes")


@query
def subtree_documents_parts(spark, d):
    """The same texts in parts of 3,000 characters."""
    n = X.nodes(spark, d)
    rendered = F.concat(F.col("name"), F.lit("="), F.col("content"))
    docs = hierarchy.subtree_documents(n, hierarchy.preorder_rows(n), rendered, separator="\n---\n", part_chars=3000, hot_rows=100)
    return docs.select("owner_id", "id", "part", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"), "n_nodes")


@query
def derive_edges(spark, d):
    return hierarchy.derive_edges(X.nodes(spark, d))


@query
def edge_drift(spark, d):
    return hierarchy.edge_drift(X.nodes(spark, d), X.edges(spark, d))


@query
def inherit_root_fields(spark, d):
    s = recall.decayed(X.states(spark, d), X.as_of())
    rows = hierarchy.inherit_root_fields(s, {"mastery": "root_mastery", "name": "root_name"})
    return rows.select("owner_id", "id", "root_id", r6("root_mastery"), "root_name")


# --- restructure -----------------------------------------------------------------------


def _with_rejects(rows: DataFrame, rejects: DataFrame) -> DataFrame:
    return rows.withColumn("reason", F.lit("ok")).unionByName(rejects.withColumn("sort_order", F.lit(None).cast("double")))


@query
def apply_creates(spark, d):
    n = X.nodes(spark, d)
    name = F.when(F.pmod("id", F.lit(6)) == 0, F.lit("\t ")).otherwise(F.concat(F.lit(" n"), F.pmod("id", F.lit(4)), F.lit("\n")))
    creates = n.select(F.col("id").alias("seq"), (F.col("id") + 1000000).alias("id"), "owner_id", "parent_id", name.alias("name"))
    made, rejects = restructure.apply_creates(n, creates)
    columns = ["seq", "owner_id", "parent_id", "name"]
    return _with_rejects(made.select(*columns, "sort_order"), rejects.select(*columns, "reason"))


@query
def apply_content_updates(spark, d):
    n = X.nodes(spark, d).select("owner_id", "id", "content", "is_deleted")
    e = X.node_reviews(spark, d)
    updates = e.select(F.col("event_id").alias("seq"), "owner_id", F.col("node_id").alias("id"),
                       F.concat(F.lit("v"), F.col("event_id")).alias("content"), F.col("reviewed_at").alias("at"))
    after, _ = restructure.apply_content_updates(n, updates)
    return after.select("owner_id", "id", F.md5("content").alias("content_md5"), text("updated_at"))


@query
def apply_cascade_delete(spark, d):
    n = X.nodes(spark, d)
    after, _ = restructure.apply_cascade_delete(n, X.labelled(spark, d, "toxic", 1))
    return after.select("owner_id", "id", "is_deleted")


@query
def apply_cascade_delete_cyclic(spark, d):
    n = X.cyclic_nodes(spark, d)
    after, _ = restructure.apply_cascade_delete(n, X.labelled(spark, d, "quality", 0))
    return after.select("owner_id", "id", "is_deleted")


@query
def apply_promote_delete(spark, d):
    n = X.nodes(spark, d)
    after, _ = restructure.apply_promote_delete(n, X.labelled(spark, d, "quality", 0))
    return after.select("owner_id", "id", "parent_id", "sort_order", "is_deleted")


@query
def apply_moves(spark, d):
    n = X.nodes(spark, d).withColumn("updated_at", X.as_of())
    moves = _moves(spark, d).withColumn("at", F.timestamp_seconds(F.unix_seconds(X.as_of()) + F.col("seq")))
    after, _ = restructure.apply_moves(n, moves)
    return after.select("owner_id", "id", "parent_id", "sort_order", text("updated_at"))


@query
def next_sort_order(spark, d):
    return restructure.next_sort_order(X.nodes(spark, d))


@query
def normalize_sibling_order(spark, d):
    return restructure.normalize_sibling_order(X.nodes(spark, d)).select("owner_id", "id", "parent_id", "sort_order")


@query
def append_order(spark, d):
    n = X.nodes(spark, d)
    arrivals = n.select((F.col("id") * 3).alias("seq"), "owner_id", "parent_id")
    return restructure.append_order(n, arrivals)


@query
def place_generated_nodes(spark, d):
    made, skipped = restructure.place_generated_nodes(X.named_nodes(spark, d), X.suggestions(spark, d))
    rows = made.select("seq", "owner_id", "name", "sort_order", "is_new_root", F.lit("ok").alias("reason"))
    lost = skipped.select("seq", "owner_id", "name", F.lit(None).cast("double").alias("sort_order"), F.lit(False).alias("is_new_root"), "reason")
    return rows.unionByName(lost)


@query
def place_extracted_nodes(spark, d):
    n = X.named_nodes(spark, d)
    p = X.suggestions(spark, d)
    found = p.select("seq", "owner_id", (F.col("seq") - F.pmod("seq", F.lit(4))).alias("parent_id"), F.concat(F.lit("s"), F.pmod("seq", F.lit(2))).alias("name"), "content")
    made, skipped = restructure.place_extracted_nodes(n, found.withColumn("parent_id", F.floor(F.col("parent_id") / 16) * 16))
    rows = made.select("seq", "owner_id", "parent_id", "name", "sort_order", F.lit("ok").alias("reason"))
    return rows.unionByName(skipped.select("seq", "owner_id", F.lit(None).cast("bigint").alias("parent_id"), "name", F.lit(None).cast("double").alias("sort_order"), "reason"))


@query
def placement_summary(spark, d):
    made, skipped = restructure.place_generated_nodes(X.named_nodes(spark, d), X.suggestions(spark, d))
    return restructure.placement_summary(made, skipped)


# --- aggregations ------------------------------------------------------------------------


def _tagged(spark, d):
    return tagging.tag_nodes(X.taggable(spark, d), X.TAG_RULES, X.OTHER)


@query
def tag_nodes(spark, d):
    return _tagged(spark, d).select("owner_id", "id", "tag")


@query
def tag_nodes_default_rules(spark, d):
    """The built-in rules over whole document texts."""
    return tagging.tag_nodes(X.nodes(spark, d)).select("owner_id", "id", "tag")


@query
def tag_counts(spark, d):
    return tagging.tag_counts(_tagged(spark, d))


@query
def domain_distribution(spark, d):
    return tagging.domain_distribution(_tagged(spark, d), X.OTHER).select("owner_id", "tag", "n", "share")


@query
def dominant_style(spark, d):
    tagged = _tagged(spark, d)
    shares = tagging.domain_distribution(tagged, X.OTHER)
    return tagging.dominant_style(shares, X.taggable(spark, d), X.STYLE_RULES)


@query
def share_of_total(spark, d):
    rows = tagging.share_of_total(X.questions(spark, d), ["owner_id"], ["difficulty"])
    return rows.select("owner_id", "difficulty", "n", r6("share"))


@query
def review_stats(spark, d):
    return recall.review_stats(hierarchy.live_nodes(X.states(spark, d)), X.as_of())


@query
def review_stats_from_log(spark, d):
    return recall.review_stats(recall.recall_state_fold(X.reviews(spark, d)), F.lit("2024-01-30 12:00:00").cast("timestamp"))


def _node_stats(spark, d):
    return recall.quiz_node_stats(X.states(spark, d), X.questions(spark, d), X.as_of())


@query
def quiz_node_stats(spark, d):
    return _node_stats(spark, d)


@query
def quiz_totals(spark, d):
    return recall.quiz_totals(X.questions(spark, d), X.records(spark, d))


@query
def learner_kpis(spark, d):
    kpis = recall.learner_kpis(_node_stats(spark, d))
    return kpis.select("owner_id", "total_nodes", "reviewed_nodes", r6("coverage"), r6("avg_mastery"), "avg_stability_days")


@query
def growth_stage(spark, d):
    return recall.growth_stages(recall.learner_kpis(_node_stats(spark, d)))


def _forest(spark, d):
    s = recall.decayed(X.states(spark, d), X.as_of())
    shape = hierarchy.subtree_shape(s, carry=("parent_id",))
    return forest.root_stats(shape, s), shape


@query
def root_stats(spark, d):
    roots, _ = _forest(spark, d)
    return roots.select(
        "owner_id", "id", "name", "descendants", "height", "subtree_size", "stability", "difficulty", "review_count",
        "review_state", r6("mastery_score"),
    )


@query
def forest_health(spark, d):
    return forest.forest_health(*_forest(spark, d))


@query
def growth_multiplier(spark, d):
    s = X.states(spark, d)
    rate = R.growth_multiplier(F.col("stability"), F.pmod("id", F.lit(11)) / 10.0)
    return s.select("id", F.round(rate, 6).alias("growth_multiplier"))


@query
def shape_ratios(spark, d):
    rows = forest.shape_ratios(*_forest(spark, d))
    return rows.select("owner_id", "n_roots", "max_depth", "total_nodes", r6("width_depth_ratio"), r6("max_subtree_ratio"))


@query
def node_depth_ratio(spark, d):
    rows = forest.node_depth_ratio(hierarchy.node_depth(X.nodes(spark, d)))
    return rows.select("owner_id", r6("node_depth_ratio"))


@query
def activity_rate(spark, d):
    return recall.activity_rate(_node_stats(spark, d)).select("owner_id", r6("activity_rate"))


@query
def size_tier(spark, d):
    return recall.size_tiers(_node_stats(spark, d))


@query
def proportional_ranges(spark, d):
    roots, shape = _forest(spark, d)
    rows = forest.proportional_ranges(roots, forest.forest_health(roots, shape))
    return rows.select("owner_id", "id", "subtree_size", r6("angle_start"), r6("angle_end"), "quota")


# --- windows, top-k ------------------------------------------------------------------------


@query
def sibling_rank(spark, d):
    return hierarchy.sibling_rank(X.nodes(spark, d)).select("owner_id", "id", "parent_id", "position")


@query
def due_queue(spark, d):
    states = hierarchy.live_nodes(X.states(spark, d))
    rows = recall.attach_content(recall.due_queue(states, X.as_of()), states)
    return rows.select(F.md5("content").alias("content_md5"), "owner_id", "id", "name", "retrievability", "stability", "difficulty", "review_count", "review_state",
                       text("next_review_at"), big("rank"))


@query
def weak_nodes(spark, d):
    rows = recall.weak_nodes(_node_stats(spark, d))
    return rows.select("owner_id", "id", "mastery_score", big("rank"))


@query
def questions_newest_first(spark, d):
    return questions.questions_newest_first(X.questions(spark, d)).select("owner_id", "id", "question", text("created_at"))


@query
def children_in_order(spark, d):
    return hierarchy.children_in_order(X.nodes(spark, d)).select("owner_id", "parent_id", "id", "sort_order", "name")


@query
def first_n_per_batch(spark, d):
    rows = generated.first_n_per_batch(X.raw_batches(spark, d), 2)
    return rows.select("id", big("position"), "question")


@query
def page_of_children(spark, d):
    return hierarchy.page_of_children(X.nodes(spark, d), 1, 2).select("owner_id", "id", "parent_id", "position")


# --- scalars, generated text ------------------------------------------------------------------


@query
def retrievability(spark, d):
    s = X.states(spark, d)
    return s.select("id", F.round(R.retrievability(F.col("stability"), F.col("last_review_at"), X.as_of()), 6).alias("retrievability"))


@query
def fsrs_step(spark, d):
    """Every event applied to a stored state."""
    e = X.reviews(spark, d)
    n = F.col("event_id")
    state = F.struct(
        (F.pmod(n, F.lit(9)) * 0.5).alias("stability"),
        (F.lit(0.05) + F.pmod(n, F.lit(10)) / 10.0).alias("difficulty"),
        F.pmod(n, F.lit(4)).cast("bigint").alias("review_count"),
        F.when(F.pmod(n, F.lit(3)) == 0, "new").when(F.pmod(n, F.lit(3)) == 1, "review").otherwise("relearning").alias("review_state"),
        F.lit(None).cast("timestamp").alias("last_review_at"),
        (F.lit(0.95) - F.pmod(n, F.lit(10)) / 10.0).alias("gap"),
    )
    stepped = e.select("event_id", state.alias("s"), "rating", "reviewed_at").select(
        "event_id", R.fsrs_step(F.col("s"), F.col("rating"), F.col("reviewed_at")).alias("t"))
    return stepped.select("event_id", F.round("t.stability", 6).alias("stability"), F.round("t.difficulty", 6).alias("difficulty"),
                          "t.review_count", "t.review_state", time_text(F.col("t.last_review_at")).alias("last_review_at"))


@query
def next_review_at(spark, d):
    s = X.states(spark, d).where(F.col("last_review_at").isNotNull())
    return s.select("id", time_text(R.next_review_at(F.col("last_review_at"), F.col("stability"))).alias("next_review_at"))


@query
def answer_to_rating(spark, d):
    rows = X.records(spark, d).withColumn("rating", R.answer_to_rating(F.col("is_correct")).cast("bigint"))
    return rows.groupBy("is_correct", "rating").agg(F.count(F.lit(1)).alias("n"))


@query
def format_stability(spark, d):
    s = X.states(spark, d).withColumn("days", F.col("stability") * F.col("stability") / 4)
    return s.select("id", R.format_stability(F.col("days")).alias("label"))


@query
def type_label(spark, d):
    q = X.questions(spark, d)
    kind = F.when(F.pmod("id", F.lit(5)) == 0, F.lit("essay")).otherwise(F.col("question_type"))
    return q.select("id", questions.type_label(kind).alias("type_label"))


@query
def decode_options(spark, d):
    q = X.questions(spark, d).select("id", questions.decode_options(F.col("options")).alias("o"))
    return q.select("id", F.array_join("o.choices", ",").alias("choices"), "o.reference_answer",
                    F.array_join("o.keywords", ",").alias("keywords"), "o.raw")


@query
def extract_json(spark, d):
    rows = X.raw_questions(spark, d).withColumn("j", generated.extract_json(F.col("raw")))
    return rows.select("id", F.col("j").isNotNull().alias("found"), F.try_variant_get("j", "$.question", "string").alias("question"))


@query
def validate_questions(spark, d):
    ok, _ = generated.validate_questions(X.raw_questions(spark, d))
    return ok.select("id", "question_type", "question", F.array_join("choices", ",").alias("choices"), "reference_answer",
                     F.array_join("keywords", ",").alias("keywords"), big("correct_index"), "explanation", "type_label")


@query
def validate_questions_rejects(spark, d):
    _, rejects = generated.validate_questions(X.raw_questions(spark, d))
    return rejects.select("id", "question_type", "reason")


@query
def explode_question_batch(spark, d):
    ok, _ = generated.explode_question_batch(X.raw_batches(spark, d), 4)
    return ok.select("id", big("position"), "question", F.array_join("choices", ",").alias("choices"), "reference_answer",
                     F.array_join("keywords", ",").alias("keywords"), big("correct_index"), "explanation", "question_type", "difficulty")


@query
def explode_question_batch_rejects(spark, d):
    _, rejects = generated.explode_question_batch(X.raw_batches(spark, d), 4)
    return rejects.select("id", "reason")


@query
def explode_suggestions(spark, d):
    ok, _ = generated.explode_suggestions(X.raw_suggestions(spark, d))
    return ok.select("id", big("position"), "name", "content", "suggested_parent")


@query
def explode_suggestions_rejects(spark, d):
    _, rejects = generated.explode_suggestions(X.raw_suggestions(spark, d))
    return rejects.select("id", "reason")


@query
def build_prompts(spark, d):
    rows = generated.build_prompts(X.nodes(spark, d), ["single_choice", "true_false"])
    return rows.select("owner_id", "id", F.md5("prompt").alias("prompt_md5"))


@query
def build_subtree_prompts(spark, d):
    n = X.nodes(spark, d)
    rows = generated.build_prompts(n, ["short_answer"], hierarchy.preorder_rows(n))
    return rows.select("owner_id", "id", "part", F.md5("prompt").alias("prompt_md5"))


# --- logs and streams ------------------------------------------------------------------------------


def _log(spark, d):
    answers = X.reviews(spark, d).select(
        (F.col("event_id") + 1000000000).alias("event_id"), "owner_id", "node_id", (F.col("rating") != 1).alias("is_correct"),
        F.timestamp_seconds(F.unix_seconds("reviewed_at") + 3600).alias("reviewed_at"),
    )
    return recall.review_log(X.reviews(spark, d), answers)


@query
def review_log(spark, d):
    return _log(spark, d).groupBy("owner_id", "rating").agg(F.count(F.lit(1)).alias("n")).select("owner_id", big("rating"), "n")


def _state_columns(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, half_up("stability"), half_up("difficulty"), "review_count", "review_state", text("last_review_at"), text("next_review_at"))


@query
def recall_state_fold(spark, d):
    return _state_columns(recall.recall_state_fold(X.reviews(spark, d)), "owner_id", "node_id")


@query
def recall_state_fold_mixed_log(spark, d):
    rows = recall.recall_state_fold(_log(spark, d))
    return rows.select("owner_id", "node_id", F.round(F.log("stability"), 6).alias("log_stability"), half_up("difficulty"), "review_count",
                       "review_state", text("last_review_at"))


@query
def recall_state_fold_blocks(spark, d):
    """Every log above ten events folded as blocks."""
    return _state_columns(recall.recall_state_fold(X.reviews(spark, d), fold_events=10), "owner_id", "node_id")


def _applied(spark, d):
    n = X.states(spark, d).withColumns({"mastery_score": F.lit(0.25), "updated_at": F.lit(None).cast("timestamp")})
    return recall.apply_reviews(n, X.node_reviews(spark, d))


@query
def apply_reviews(spark, d):
    return _state_columns(_applied(spark, d)[0], "owner_id", "id", "mastery_score", text("updated_at"))


@query
def apply_reviews_rejects(spark, d):
    return _applied(spark, d)[1].select("event_id", "owner_id", "node_id", "reason")


@query
def recall_state_history_blocks(spark, d):
    """Every log above ten events followed through blocks."""
    return _state_columns(recall.recall_state_history(X.reviews(spark, d), history_events=10), "owner_id", "node_id", "event_id")


@query
def recall_state_history(spark, d):
    return _state_columns(recall.recall_state_history(X.reviews(spark, d)), "owner_id", "node_id", "event_id")


@query
def daily_review_counts(spark, d):
    return recall.daily_review_counts(X.reviews(spark, d))


@query
def recall_state_stream(spark, d):
    return _state_columns(jobs.fold_stream(X.review_arrivals(spark, d), X.STREAM_DELAY_SECONDS)[0], "owner_id", "node_id")


@query
def recall_state_stream_late(spark, d):
    late = jobs.fold_stream(X.review_arrivals(spark, d), X.STREAM_DELAY_SECONDS)[1]
    return late.select("owner_id", "node_id", "event_id", text("reviewed_at"))


@query
def recall_state_stream_keyed(spark, d):
    changes = jobs.run_keyed(jobs.recall_state_changes(X.review_arrivals(spark, d), X.STREAM_DELAY))
    return _state_columns(jobs.current_states(changes), "owner_id", "node_id")


@query
def recall_state_stream_keyed_late(spark, d):
    changes = jobs.run_keyed(jobs.recall_state_changes(X.review_arrivals(spark, d), X.STREAM_DELAY))
    return jobs.late_reviews(changes).select("owner_id", "node_id", "event_id", text("reviewed_at"))


@query
def daily_review_counts_stream(spark, d):
    return jobs.count_stream(X.review_arrivals(spark, d), X.STREAM_DELAY_SECONDS)[0].select("owner_id", "day", "reviews")


@query
def daily_review_counts_late(spark, d):
    return jobs.count_stream(X.review_arrivals(spark, d), X.STREAM_DELAY_SECONDS)[1].select("owner_id", "event_id", "day")


@query
def stream_insert_ignore(spark, d):
    rows = X.record_arrivals(spark, d).select("order_key", "line", "answered_at")
    return jobs.insert_stream(rows, ["order_key", "line"], ["answered_at"])[0].select("order_key", "line")


@query
def stream_insert_into_table(spark, d):
    rows = X.record_arrivals(spark, d).select("order_key", "line", "question_id", "price")
    return jobs.insert_stream(rows, ["order_key", "line"], ["question_id", "price"])[0].select(*rows.columns)


@query
def stream_wrong_attempts(spark, d):
    attempts = X.records_of(X.read_stream(spark, d, "lineitem"))
    wrong = jobs.run_to_table(jobs.wrong_attempts(attempts, X.questions(spark, d)))
    return wrong.groupBy("owner_id", "question_id").agg(F.count(F.lit(1)).alias("n"), time_text(F.max("answered_at")).alias("last_wrong_at"))
