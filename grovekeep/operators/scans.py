"""Reading, importing, appending and upserting domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.scalars import computed_once, strip
from .keyed import first_rows, last_rows, null_safe_join


def scan_nodes(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Live rows, only the named columns; both reach the parquet scan."""
    return nodes.where(~F.col("is_deleted")).select(*columns)


def root_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("is_deleted") & F.col("parent_id").isNull())


def node_view(nodes: DataFrame) -> DataFrame:
    """The outward shape of a node."""
    return nodes.select(
        "id",
        "name",
        F.coalesce("content", F.lit("")).alias("content"),
        F.col("parent_id").alias("parentId"),
        F.col("sort_order").alias("sortOrder"),
    )


def null_safe_parent_match(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes whose (owner, parent) is listed, a null parent matching null."""
    return null_safe_join(nodes, parents, ["owner_id", "parent_id"], "left_semi")


def non_blank_content(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.length(strip(F.coalesce("content", F.lit("")))) > 0)


def clean_names(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their name trimmed, and rows whose name is empty after that."""
    trimmed = incoming.withColumn("name", strip(F.coalesce("name", F.lit(""))))
    return trimmed.where(F.length("name") > 0), trimmed.where(F.length("name") == 0)


# --- import -------------------------------------------------------------------


def ingest_json_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node records of JSON arrays ``raw(source, raw)``, and the rejected items.

    Items need a text id and a text name.  Defaults: empty content, no parent,
    and the position among the accepted items as order.
    """
    items = F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>")
    parsed = computed_once(raw, _items=items)

    def is_text(item: Column, key: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(item, f"$.{key}", "variant")) == "STRING", F.lit(False))

    good = F.filter("_items", lambda i: is_text(i, "id") & is_text(i, "name"))
    bad = F.filter("_items", lambda i: ~(is_text(i, "id") & is_text(i, "name")))
    rows = parsed.where(F.col("_items").isNotNull()).select("source", F.posexplode(good).alias("position", "item"))

    def text(key: str) -> Column:
        return F.try_variant_get("item", f"$.{key}", "string")

    def numeric(key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get("item", f"$.{key}", "variant"))
        known = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")
        return F.when(known, F.try_variant_get("item", f"$.{key}", "double"))

    content = F.when(is_text(F.col("item"), "content"), text("content")).otherwise(F.lit(""))
    accepted = rows.select(
        "source",
        text("id").alias("id"),
        text("name").alias("name"),
        content.alias("content"),
        F.nullif(text("parentId"), F.lit("")).alias("parent_id"),
        F.coalesce(numeric("sortOrder"), F.col("position").cast("double")).alias("sort_order"),
    )
    lost_items = parsed.where(F.col("_items").isNotNull()).select("source", F.explode(bad).alias("item")).select(
        "source", F.to_json("item").alias("raw"), F.lit("missing_id_or_name").alias("reason")
    )
    lost_files = parsed.where(F.col("_items").isNull()).select("source", "raw", F.lit("not_an_array").alias("reason"))
    return accepted, lost_items.unionByName(lost_files)


def _time_of(text: str) -> Column:
    """A time stored as text, with or without zone; null if empty or no time."""
    return F.try_to_timestamp(F.nullif(strip(F.col(text)), F.lit("")))


def import_legacy_nodes(source: DataFrame) -> DataFrame:
    """Rows of the older store in the node schema, with defaults for missing fields; a time that is missing or unreadable is null."""
    shape = F.schema_of_variant(F.try_parse_json("content"))
    is_object = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    content = F.when(is_object, F.coalesce(F.get_json_object("content", "$.markdown"), F.col("content"))).otherwise(
        F.coalesce("content", F.lit(""))
    )
    return source.select(
        "id",
        "owner_id",
        "name",
        content.alias("content"),
        F.col("parent_id_cache").alias("parent_id"),
        F.coalesce("sort_order", F.lit(0.0)).alias("sort_order"),
        F.coalesce(F.col("depth").cast("bigint"), F.lit(0).cast("bigint")).alias("depth"),
        F.coalesce("domain_tag", F.lit(V.OTHER_TAG)).alias("domain_tag"),
        F.coalesce(F.col("mastery_score").cast("double"), F.lit(0.0)).alias("mastery_score"),
        F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"),
        _time_of("created_at").alias("created_at"),
        _time_of("updated_at").alias("updated_at"),
    )


def import_legacy_edges(source: DataFrame) -> DataFrame:
    """Edges of the older store, with defaults for missing fields; :func:`insert_ignore` by parent and child adds the new ones."""
    return source.select(
        "parent_id",
        "child_id",
        F.coalesce(F.col("sort_order").cast("double"), F.lit(0.0)).alias("sort_order"),
        F.coalesce("relationship_type", F.lit("parent-child")).alias("relationship_type"),
    )


def import_legacy_records(source: DataFrame) -> DataFrame:
    """Attempt records of the older store, which know no question; a missing result is a wrong answer."""
    return source.select(
        "id",
        "node_id",
        "owner_id",
        F.lit(None).cast("string").alias("question_id"),
        F.coalesce("is_correct", F.lit(False)).alias("is_correct"),
        _time_of("answered_at").alias("answered_at"),
    )


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key is new, the first of each key."""
    return first_rows(incoming, keys, order).join(target.select(*keys), keys, "left_anti")


def append_sink(df: DataFrame, path: str) -> None:
    """Append rows to a parquet table."""
    df.write.mode("append").parquet(path)


def upsert_by_key(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``target`` with the non-null columns of ``changes`` written over it.

    Of several changes of one key the last by ``order`` counts, by default by all columns.
    """
    names = [c for c in changes.columns if c not in keys]
    changes = last_rows(changes, keys, order or names)
    names = [c for c in names if c in target.columns]
    renamed = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = target.join(renamed, keys, "left")
    updated = {c: F.coalesce(f"_new_{c}", c) for c in names}
    return joined.withColumns(updated).select(*target.columns)


def evolve_schema(df: DataFrame, defaults: dict[str, tuple[T.DataType, object]]) -> DataFrame:
    """Add the missing columns, filled with their defaults."""
    missing = {c: F.lit(value).cast(kind) for c, (kind, value) in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def import_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per imported table."""
    counts = [df.select(F.lit(name).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows")) for name, df in tables.items()]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def missing_owners(nodes: DataFrame, users: DataFrame) -> DataFrame:
    """Owners of live nodes without a user row."""
    owners = nodes.where(~F.col("is_deleted")).select("owner_id").distinct()
    return owners.join(users.select(F.col("id").alias("owner_id")), "owner_id", "left_anti")


def owners_minus_users(nodes: DataFrame, users: DataFrame) -> DataFrame:
    """The same set as :func:`missing_owners`, as a set difference."""
    owners = nodes.where(~F.col("is_deleted")).select("owner_id")
    return owners.subtract(users.select(F.col("id").alias("owner_id")))
