"""Domain tables derived from the generic test tables.

Every derivation is a narrow projection (column arithmetic, no shuffle), so the
filters and column choices of the operators still reach the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_path
from ..streaming.jobs import closing_row

AS_OF = "2024-01-31 00:00:00"
STRIDE = 20
STREAM_DELAY = "1 hour"
STREAM_DELAY_SECONDS = 3600

TAG_RULES = {"color": ["blue", "red"], "size": ["large", "small"], "tool": ["bolt", "gear"]}
STYLE_RULES = [("color", 0.40, "sakura"), ("size", 0.30, "cyberpunk"), ("tool", 0.10, "ink")]
OTHER = "other"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARRIVALS = 4
FILES = 2


def arrivals(rows: DataFrame, event_time: str, late: Column, again: Column, closing: DataFrame | None = None) -> DataFrame:
    """``rows`` as a stream of ``ARRIVALS`` triggers, in the order of ``event_time``.

    Rows that are ``late`` come with the last arrival whatever their time, and rows to be sent ``again`` come
    with it once more; ``closing`` comes after it.
    """
    spark = rows.sparkSession
    at = F.unix_micros(F.col(event_time).cast("timestamp"))
    low, high = rows.agg(F.min(at), F.max(at)).first()
    part = F.when(late, ARRIVALS - 1).otherwise(F.least(F.lit(ARRIVALS - 1), F.floor((at - low) * ARRIVALS / (high - low + 1))))
    folder = new_path(spark, "arrivals")
    for i in range(ARRIVALS):
        now = rows.where(part == i)
        now = now.unionByName(rows.where(again)) if i == ARRIVALS - 1 else now
        now.repartition(FILES).write.mode("append").parquet(folder)
    if closing is not None:
        closing.write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def review_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews as a stream that ends; every fortieth comes with the last arrival."""
    rows = reviews(spark, sf_dir)
    return arrivals(rows, "reviewed_at", F.pmod("event_id", F.lit(40)) == 11, F.lit(False), closing_row(spark, rows.schema, "reviewed_at"))


def record_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as a stream; those of every tenth order are sent twice."""
    return arrivals(records_of(read(spark, sf_dir, "lineitem")), "answered_at", F.lit(False), F.pmod("order_key", F.lit(10)) == 3)


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files."""
    schema = read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _days_before(days: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(as_of()) - days * 86400)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three roots per owner, three children per node, some names shared, some rows deleted."""
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    ordinal = F.floor(n / STRIDE)
    return d.select(
        n.alias("id"),
        F.col("source").alias("owner_id"),
        F.when(ordinal >= 3, F.pmod(n, F.lit(STRIDE)) + STRIDE * F.floor((ordinal - 3) / 3)).alias("parent_id"),
        F.concat(F.lit("n"), F.pmod(ordinal, F.lit(2))).alias("name"),
        F.col("text").alias("content"),
        F.pmod(n, F.lit(5)).cast("double").alias("sort_order"),
        (F.pmod(n, F.lit(17)) == 5).alias("is_deleted"),
    )


def deep_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deeper forest without deletions: the parent is 1 to 5 places back."""
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    ordinal = F.floor(n / STRIDE)
    parent = ordinal - 1 - F.pmod(ordinal, F.lit(5))
    return d.select(
        n.alias("id"),
        F.col("source").alias("owner_id"),
        F.when(parent >= 0, F.pmod(n, F.lit(STRIDE)) + STRIDE * parent).alias("parent_id"),
        F.concat(F.lit("n"), ordinal).alias("name"),
        F.pmod(n, F.lit(5)).cast("double").alias("sort_order"),
        F.lit(False).alias("is_deleted"),
    )


def cyclic_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest with every owner's first root hung under one of its own descendants.

    That makes a cycle of two, with a whole subtree below it.
    """
    base = nodes(spark, sf_dir)
    loop = F.col("id") < 10
    return base.withColumn("parent_id", F.when(loop, F.col("id") + STRIDE * 3).otherwise(F.col("parent_id")))


def labelled(spark: SparkSession, sf_dir: str, label: str, value: int) -> DataFrame:
    """Keys of the nodes a label marks: who is asked to move or to go."""
    marked = read(spark, sf_dir, "labels").where(F.col(label) == value).select(F.col("doc_id").alias("id"))
    return nodes(spark, sf_dir).select("owner_id", "id").join(marked, "id", "left_semi").select("owner_id", "id")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with stored recall fields: some unseen, some overdue, some zero."""
    base = nodes(spark, sf_dir)
    n = F.col("id")
    seen = F.pmod(n, F.lit(4)) != 0
    stability = F.when(seen, F.pmod(n, F.lit(13)) * 1.5).otherwise(F.lit(0.0))
    last = F.when(seen, _days_before(F.pmod(n, F.lit(30))))
    return base.withColumns(
        {
            "stability": stability,
            "difficulty": F.pmod(n, F.lit(10)) / 10.0,
            "review_count": F.when(seen, F.pmod(n, F.lit(6))).otherwise(F.lit(0)).cast("bigint"),
            "review_state": F.when(~seen, F.when(F.pmod(n, F.lit(8)) == 0, F.lit("new"))).otherwise(
                F.when(F.pmod(n, F.lit(3)) == 0, F.lit("relearning")).otherwise(F.lit("review"))
            ),
            "last_review_at": last,
            "next_review_at": F.timestamp_seconds(F.floor(F.unix_seconds(last) + stability * 86400)),
        }
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored edge table that has drifted from the nodes."""
    base = nodes(spark, sf_dir).where(F.col("parent_id").isNotNull() & (F.pmod("id", F.lit(11)) != 3))
    moved = F.when(F.pmod("id", F.lit(23)) == 7, F.lit(99.0)).otherwise(F.col("sort_order"))
    return base.select("parent_id", F.col("id").alias("child_id"), moved.alias("sort_order"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").where(F.pmod("s_suppkey", F.lit(3)) != 0)
    return s.select(F.concat(F.lit("src"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("username"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews_of(read(spark, sf_dir, "events"))


def reviews_of(events: DataFrame) -> DataFrame:
    rating = (
        F.when(F.col("event_type") == "error", 1)
        .when(F.col("event_type") == "view", 2)
        .when(F.col("event_type") == "purchase", 4)
        .otherwise(3)
    )
    return events.select(
        "event_id",
        F.col("user_id").alias("owner_id"),
        F.pmod(F.get_json_object("props", "$.k").cast("bigint"), F.lit(8)).alias("node_id"),
        rating.alias("rating"),
        F.col("ts").cast("timestamp").alias("reviewed_at"),
    )


def node_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of document nodes, a third of them sent by another owner, some rated 0 or 5."""
    e = read(spark, sf_dir, "events")
    node = F.floor(F.col("event_id") / 10)
    sender = F.when(F.pmod("event_id", F.lit(3)) == 0, F.col("user_id")).otherwise(node)
    return e.select(
        "event_id",
        F.concat(F.lit("src"), F.pmod(sender, F.lit(STRIDE))).alias("owner_id"),
        node.alias("node_id"),
        F.pmod("event_id", F.lit(6)).cast("int").alias("rating"),
        F.col("ts").cast("timestamp").alias("reviewed_at"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    n = F.col("p_partkey")
    kind = F.pmod(n, F.lit(3))
    question_type = F.when(kind == 0, "single_choice").when(kind == 1, "true_false").otherwise("short_answer")
    index = F.when(kind == 0, F.pmod(n, F.lit(4))).when(kind == 1, F.pmod(n, F.lit(2))).otherwise(F.lit(0))
    level = F.when(F.col("p_size") < 17, "easy").when(F.col("p_size") < 34, "medium").otherwise("hard")
    options = (
        F.when(kind == 0, F.lit('["A","B","C","D"]'))
        .when(kind == 1, F.lit("not json"))
        .otherwise(F.concat(F.lit('{"reference_answer":"'), F.col("p_name"), F.lit('","keywords":["k1","k2"]}')))
    )
    return p.select(
        n.alias("id"),
        F.pmod(n, F.lit(500)).alias("node_id"),
        F.concat(F.lit("src"), F.pmod(n, F.lit(STRIDE))).alias("owner_id"),
        F.col("p_name").alias("question"),
        options.alias("options"),
        index.cast("int").alias("correct_index"),
        F.concat(F.lit("see "), F.col("p_type")).alias("explanation"),
        question_type.alias("question_type"),
        level.alias("difficulty"),
        _days_before(F.pmod(n * 7, F.lit(365))).alias("created_at"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(read(spark, sf_dir, "lineitem"))


def records_of(lines: DataFrame) -> DataFrame:
    """Attempts; the key columns tell equal-time attempts apart."""
    return lines.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_partkey").alias("question_id"),
        F.concat(F.lit("src"), F.pmod("l_suppkey", F.lit(STRIDE))).alias("owner_id"),
        F.pmod("l_linenumber", F.lit(4)).cast("int").alias("chosen_index"),
        (F.col("l_returnflag") != "R").alias("is_correct"),
        F.col("l_shipdate").cast("timestamp").alias("answered_at"),
    )


def taggable(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("owner_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("content"),
        F.lit(False).alias("is_deleted"),
    )


def keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per document: a few characters from its text, in one of fifty domains."""
    d = read(spark, sf_dir, "documents")
    domain = F.concat(F.lit("d"), F.pmod("doc_id", F.lit(50)))
    return d.select(F.col("doc_id").alias("prio"), domain.alias("domain"), F.substring("text", 11, 9).alias("keyword"))


def named_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with wordy names, for parent matching: every fourth has a parent."""
    p = read(spark, sf_dir, "part")
    n = F.col("p_partkey")
    return p.select(
        n.alias("id"),
        F.col("p_brand").alias("owner_id"),
        F.when(F.pmod(n, F.lit(4)) == 3, n - 3).alias("parent_id"),
        F.concat(F.initcap("p_name"), F.lit(" "), F.pmod(n, F.lit(7))).alias("name"),
        F.pmod(n, F.lit(5)).cast("double").alias("sort_order"),
        (F.pmod(n, F.lit(17)) == 5).alias("is_deleted"),
    )


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated nodes naming a parent that is longer, shorter, absent, empty, or made by the same response."""
    p = read(spark, sf_dir, "part")
    n = F.col("p_partkey")
    kind = F.pmod(n, F.lit(5))
    parent = (
        F.when(kind == 0, F.concat(F.lit("all about "), F.col("p_name"), F.lit(" 3 and more")))
        .when(kind == 1, F.upper(F.substring_index("p_name", " ", 1)))
        .when(kind == 2, F.concat(F.lit("topic "), F.pmod(n, F.lit(3))))
        .when(kind == 3, F.substring_index("p_name", " ", -1))
        .when(F.pmod(n, F.lit(10)) == 9, F.concat(F.lit("About S"), F.pmod(n, F.lit(3)), F.lit(" here")))
        .otherwise(F.lit(""))
    )
    return p.select(
        n.alias("seq"),
        F.col("p_brand").alias("owner_id"),
        F.concat(F.lit("s"), F.pmod(n, F.lit(3))).alias("name"),
        F.col("p_type").alias("content"),
        parent.alias("suggested_parent"),
        F.floor(n / 200).alias("response_id"),
    )


def raw_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated question text of every quality: JSON, fenced, broken, incomplete."""
    p = read(spark, sf_dir, "part")
    n = F.col("p_partkey")
    body = F.concat(
        F.lit('{"question":"'), F.col("p_name"), F.lit('?","options":["A","B","C","D"],"correct_index":'),
        F.pmod(n, F.lit(4)).cast("string"), F.lit(',"explanation":"e"}'),
    )
    kind = F.pmod(n, F.lit(10))
    raw = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone")))
        .when(kind == 2, F.concat(F.lit("```\n"), body, F.lit("\n```")))
        .when(kind == 3, F.concat(F.lit("no json about "), F.col("p_name")))
        .when(kind == 4, F.lit('{"question":"q","options":["A","B","C","D"],"correct_index":1}'))
        .when(kind == 5, F.lit('{"question":"q","options":["A","B","C"],"correct_index":1,"explanation":"e"}'))
        .when(kind == 6, F.lit('{"question":"q","options":["A","B","C","D"],"correct_index":7,"explanation":"e"}'))
        .when(kind == 7, F.concat(F.lit('{"question":"'), F.col("p_name"), F.lit('","correct_index":1,"explanation":"t"}')))
        .when(
            kind == 8,
            F.concat(F.lit('{"question":"'), F.col("p_name"), F.lit('","reference_answer":"r","keywords":["k"]}')),
        )
        .otherwise(F.lit('{"question":"q","reference_answer":"r","keywords":"none"}'))
    )
    asked = (
        F.when(kind == 7, F.lit("true_false")).when(kind >= 8, F.lit("short_answer")).otherwise(F.lit("single_choice"))
    )
    return p.select(n.alias("id"), asked.alias("question_type"), raw.alias("raw"))


def raw_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated batches of mixed question types, some of them unusable."""
    p = read(spark, sf_dir, "part")
    n = F.col("p_partkey")
    kind = F.pmod(n, F.lit(5))
    mixed = F.concat(
        F.lit('{"questions":[{"question":"'), F.col("p_name"),
        F.lit(' one","options":["A","B","C","D"],"correct_index":2,"explanation":"x"},'
              '{"question":"two","question_type":"true_false","correct_index":5},'
              '{"question":"three","question_type":"short_answer","reference_answer":"ra","keywords":["k1"]},'
              '{"question":"four","options":["A","B"],"difficulty":"hard","question_type":"essay"}]}'),
    )
    raw = (
        F.when(kind == 0, mixed)
        .when(kind == 1, F.concat(F.lit("```json\n"), mixed, F.lit("\n```")))
        .when(kind == 2, F.lit('{"questions":"none"}'))
        .when(kind == 3, F.lit('{"questions":[{"question":"q"}]}'))
        .otherwise(F.col("p_name"))
    )
    return p.select(n.alias("id"), raw.alias("raw"))


def raw_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    n = F.col("p_partkey")
    kind = F.pmod(n, F.lit(4))
    good = F.concat(
        F.lit('{"nodes":[{"name":"'), F.col("p_name"), F.lit('","content":"c1","suggested_parent":"'),
        F.col("p_type"), F.lit('"},{"name":"second","content":"c2","suggested_parent":"p"}]}'),
    )
    raw = (
        F.when(kind == 0, good)
        .when(kind == 1, F.concat(F.lit("Here\n```\n"), good, F.lit("\n```")))
        .when(kind == 2, F.lit('{"nodes":[{"name":"a","content":"b"}]}'))
        .otherwise(F.lit("[]"))
    )
    return p.select(n.alias("id"), raw.alias("raw"))


def raw_node_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array of node records per part: some items lack an id, a name or an order."""
    p = read(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("string")
    raw = F.when(
        F.pmod("p_partkey", F.lit(9)) == 4, F.concat(F.lit("broken "), n)
    ).otherwise(
        F.concat(
            F.lit('[{"id":"a'), n, F.lit('","name":"'), F.col("p_name"), F.lit('","content":"c","parentId":"","sortOrder":4},{"id":"b'),
            n, F.lit('","name":"x","parentId":"a'), n, F.lit('"},{"id":7,"name":"y"},{"name":"z"},{"id":"c'), n,
            F.lit('","name":"w","content":5,"sortOrder":"no"}]'),
        )
    )
    return p.select(F.col("p_partkey").alias("source"), raw.alias("raw"))


def legacy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older store: content is text or an object, some fields are missing."""
    p = read(spark, sf_dir, "part")
    n = F.col("p_partkey")
    kind = F.pmod(n, F.lit(3))
    content = (
        F.when(kind == 0, F.concat(F.lit('{"markdown":"# '), F.col("p_name"), F.lit('"}')))
        .when(kind == 1, F.lit('{"other":1}'))
        .otherwise(F.col("p_name"))
    )
    return p.select(
        n.cast("string").alias("id"),
        F.col("p_brand").alias("owner_id"),
        F.col("p_name").alias("name"),
        content.alias("content"),
        F.when(kind != 0, (n - 1).cast("string")).alias("parent_id_cache"),
        F.when(F.pmod(n, F.lit(4)) != 0, F.pmod(n, F.lit(5)).cast("double")).alias("sort_order"),
        F.when(F.pmod(n, F.lit(2)) == 0, F.col("p_type")).alias("domain_tag"),
        F.when(F.pmod(n, F.lit(7)) == 0, F.lit(True)).alias("is_deleted"),
        F.when(F.pmod(n, F.lit(3)) != 2, F.pmod(n, F.lit(6))).alias("depth"),
        F.when(F.pmod(n, F.lit(5)) != 1, F.pmod(n, F.lit(9)) / 8).alias("mastery_score"),
        legacy_time(n, 4).alias("created_at"),
        legacy_time(n + 1, 4).alias("updated_at"),
    )


def legacy_time(n: Column, kinds: int) -> Column:
    """A time as the older store has it: plain, in the ISO form with zone, empty or missing."""
    day = F.lpad((F.pmod(n, F.lit(28)) + 1).cast("string"), 2, "0")
    kind = F.pmod(n, F.lit(kinds))
    return (
        F.when(kind == 0, F.concat(F.lit("2023-05-"), day, F.lit(" 07:08:09")))
        .when(kind == 1, F.concat(F.lit("2023-05-"), day, F.lit("T07:08:09+02:00")))
        .when(kind == 2, F.lit(""))
    )


def legacy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of an older store, some without order or type."""
    n = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        (n - 1).cast("string").alias("parent_id"),
        n.cast("string").alias("child_id"),
        F.when(F.pmod(n, F.lit(4)) != 0, F.pmod(n, F.lit(5))).alias("sort_order"),
        F.when(F.pmod(n, F.lit(3)) == 0, F.lit("related")).alias("relationship_type"),
    )


def legacy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of an older store, some without a result or a time."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(
        key.cast("string").alias("id"),
        F.col("l_partkey").cast("string").alias("node_id"),
        F.concat(F.lit("src"), F.pmod("l_suppkey", F.lit(20))).alias("owner_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("is_correct"),
        legacy_time(key, 5).alias("answered_at"),
    )
