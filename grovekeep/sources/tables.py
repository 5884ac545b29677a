"""Schemas of the domain tables, and parquet / JSON readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECALL_DEFAULTS = {
    "stability": (T.DoubleType(), 0.0),
    "difficulty": (T.DoubleType(), 0.3),
    "last_review_at": (T.TimestampType(), None),
    "next_review_at": (T.TimestampType(), None),
    "review_count": (T.LongType(), 0),
    "review_state": (T.StringType(), "new"),
}

NODE_DEFAULTS = {
    "mastery_score": (T.DoubleType(), 0.0),
    "depth": (T.LongType(), 0),
    **RECALL_DEFAULTS,
}


# Schemas as DDL text.
USERS = "id string not null, username string, created_at timestamp"
NODES = (
    "id string not null, owner_id string not null, name string, content string, parent_id string, "
    "sort_order double, depth bigint, domain_tag string, mastery_score double, is_deleted boolean, "
    "created_at timestamp, updated_at timestamp, stability double, difficulty double, "
    "last_review_at timestamp, next_review_at timestamp, review_count bigint, review_state string"
)
EDGES = "parent_id string, child_id string, sort_order double, relationship_type string"
QUESTIONS = (
    "id string not null, node_id string, owner_id string, question string, options string, correct_index int, "
    "explanation string, question_type string, difficulty string, created_at timestamp"
)
RECORDS = (
    "id string not null, node_id string, owner_id string, question_id string, is_correct boolean, answered_at timestamp"
)
REVIEWS = "event_id string not null, owner_id string, node_id string, rating int, reviewed_at timestamp"

SCHEMAS = {
    "users": USERS, "nodes": NODES, "edges": EDGES, "quiz_questions": QUESTIONS,
    "quiz_records": RECORDS, "reviews": REVIEWS,
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A domain table stored as parquet, with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def read_json_table(spark: SparkSession, folder: str, name: str, *, schema: str | None = None) -> DataFrame:
    """A domain table stored as JSON lines, with its declared schema."""
    return spark.read.schema(schema or SCHEMAS[name]).json(f"{folder}/{name}")


def write_table(df: DataFrame, folder: str, name: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(f"{folder}/{name}")


# Keys by which each table is joined and grouped most.
BUCKET_KEYS = {
    "nodes": ["id"], "edges": ["child_id"], "quiz_questions": ["id"], "quiz_records": ["question_id"],
    "reviews": ["owner_id", "node_id"],
}


def save_bucketed(df: DataFrame, table: str, keys: list[str], buckets: int, *, path: str | None = None) -> DataFrame:
    """Save as a catalog table bucketed by ``keys``; joins and groups on them then need no shuffle.

    Buckets hold whole keys, so this suits keys without a hot value.
    """
    writer = df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array, as rows (source, raw); one file is one row."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("source"), F.col("value").alias("raw")
    )
