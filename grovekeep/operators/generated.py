"""Generated JSON text: extraction, validation with rejects, and prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import choose, computed_once
from .hierarchy import PART_CHARS, live_nodes, subtree_documents
from .questions import type_label


def extract_json(raw: Column) -> Column:
    """The whole text as JSON, else its first fenced block; null if neither parses."""
    fenced = F.nullif(F.regexp_extract(raw, V.FENCED_BLOCK, 1), F.lit(""))
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(fenced))


def _field(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def _is_list(value: Column) -> Column:
    return _kind(value).startswith("ARRAY")


def _has(value: Column, *names: str) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & _field(value, name).isNotNull()
    return found


def _index(value: Column, name: str = "correct_index") -> Column:
    """A whole number; true and false count as 1 and 0."""
    item = _field(value, name)
    return F.when(_kind(item).isin("BIGINT", "BOOLEAN"), _field(value, name, "int"))


def _binary_index(value: Column) -> Column:
    number = _field(value, "correct_index", "double")
    return F.when(F.coalesce(number.isin(0.0, 1.0), F.lit(False)), number.cast("int"))


def _true_false() -> Column:
    return F.array(*[F.lit(c) for c in V.TRUE_FALSE_CHOICES])


def _parsed(raw: DataFrame) -> DataFrame:
    return computed_once(raw, _json=extract_json(F.col("raw")))


def validate_questions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single generated questions ``raw(id, question_type, raw)``: accepted and rejected.

    An unknown question type is read as single choice.
    """
    j = F.col("_json")
    kind = F.when(F.col("question_type").isin(*V.TYPE_LABELS), F.col("question_type")).otherwise(F.lit("single_choice"))
    rows = _parsed(raw).withColumn("question_type", kind)
    options, keywords = _field(j, "options"), _field(j, "keywords")
    is_single, is_tf = F.col("question_type") == "single_choice", F.col("question_type") == "true_false"
    is_short = F.col("question_type") == "short_answer"
    complete = (
        F.when(is_single, _has(j, "question", "options", "correct_index", "explanation"))
        .when(is_tf, _has(j, "question", "correct_index", "explanation"))
        .otherwise(_has(j, "question", "reference_answer", "keywords"))
    )
    four = _is_list(options) & F.coalesce(F.size(_field(j, "options", "array<variant>")) == 4, F.lit(False))
    in_range = F.coalesce(_index(j).between(0, 3), F.lit(False))
    reason = choose(
        [
            (j.isNull(), F.lit("not_json")),
            (~_kind(j).startswith("OBJECT"), F.lit("not_an_object")),
            (~complete, F.lit("missing_key")),
            (is_single & ~four, F.lit("options_not_four")),
            (is_single & ~in_range, F.lit("index_out_of_range")),
            (is_tf & _binary_index(j).isNull(), F.lit("index_out_of_range")),
            (is_short & ~_is_list(keywords), F.lit("keywords_not_list")),
        ],
        F.lit(None).cast("string"),
    )
    rows = computed_once(rows, reason=reason)
    answer = _field(j, "reference_answer", "string")
    accepted = rows.where(F.col("reason").isNull()).select(
        "id",
        "question_type",
        _field(j, "question", "string").alias("question"),
        F.when(is_single, _field(j, "options", "array<string>")).when(is_tf, _true_false()).alias("choices"),
        F.when(is_short, answer).alias("reference_answer"),
        F.when(is_short, _field(j, "keywords", "array<string>")).alias("keywords"),
        F.when(is_single, _index(j)).when(is_tf, _binary_index(j)).otherwise(F.lit(0)).alias("correct_index"),
        F.coalesce(_field(j, "explanation", "string"), F.when(is_short, answer)).alias("explanation"),
        type_label(F.col("question_type")).alias("type_label"),
    )
    return accepted, rows.where(F.col("reason").isNotNull()).select("id", "question_type", "raw", "reason")


def explode_question_batch(raw: DataFrame, count: int, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Questions of generated batches ``raw(id, raw)``, the first ``count`` of each.

    A batch with one unusable question is rejected as a whole.  ``strict`` also
    demands four options and an index in range of choice questions.
    """
    j = F.col("_json")
    questions = _field(j, "questions", "array<variant>")
    rows = computed_once(_parsed(raw), _all=F.when(_is_list(_field(j, "questions")), questions))

    def kind_of(q: Column) -> Column:
        return F.coalesce(_field(q, "question_type", "string"), F.lit("single_choice"))

    def lacks_options(q: Column) -> Column:
        return ~kind_of(q).isin("true_false", "short_answer") & ~_is_list(_field(q, "options"))

    def off_limits(q: Column) -> Column:
        four = F.coalesce(F.size(_field(q, "options", "array<variant>")) == 4, F.lit(False))
        in_range = F.coalesce(_index(q).between(0, 3), F.lit(False))
        return ~kind_of(q).isin("true_false", "short_answer") & ~(four & in_range)

    rows = rows.withColumn("_taken", F.slice("_all", 1, count))
    reasons = [
        (j.isNull(), F.lit("not_json")),
        (F.col("_all").isNull(), F.lit("no_question_list")),
        (F.exists("_all", lacks_options), F.lit("missing_options")),
        (F.exists("_taken", lambda q: _field(q, "question").isNull()), F.lit("missing_question")),
    ]
    if strict:
        reasons.append((F.exists("_all", off_limits), F.lit("options_or_index")))
    rows = computed_once(rows, reason=choose(reasons, F.lit(None).cast("string")))
    q = F.col("q")
    given = kind_of(q)
    is_tf, is_short = given == "true_false", given == "short_answer"
    accepted = rows.where(F.col("reason").isNull()).select("id", F.posexplode("_taken").alias("position", "q"))
    index = F.when(is_tf, F.coalesce(_binary_index(q), F.lit(0))).when(is_short, F.lit(0)).otherwise(
        F.coalesce(_field(q, "correct_index", "int"), F.lit(0))
    )
    answer = F.coalesce(_field(q, "reference_answer", "string"), F.lit(""))
    explanation = F.coalesce(_field(q, "explanation", "string"), F.when(is_short, answer).otherwise(F.lit("")))
    out = accepted.select(
        "id",
        "position",
        _field(q, "question", "string").alias("question"),
        F.when(is_tf, _true_false()).when(~is_short, _field(q, "options", "array<string>")).alias("choices"),
        F.when(is_short, answer).alias("reference_answer"),
        F.when(is_short, F.coalesce(_field(q, "keywords", "array<string>"), F.array().cast("array<string>"))).alias("keywords"),
        index.alias("correct_index"),
        explanation.alias("explanation"),
        F.when(is_tf | is_short, given).otherwise(F.lit("single_choice")).alias("question_type"),
        F.coalesce(_field(q, "difficulty", "string"), F.lit(V.DEFAULT_QUESTION_DIFFICULTY)).alias("difficulty"),
    )
    out = out.withColumn("type_label", type_label(F.col("question_type")))
    return out, rows.where(F.col("reason").isNotNull()).select("id", "raw", "reason")


def first_n_per_batch(raw: DataFrame, count: int) -> DataFrame:
    """Batch id, position and question of the first ``count`` questions."""
    return explode_question_batch(raw, count)[0].select("id", "position", "question")


def explode_suggestions(raw: DataFrame, *, with_parent: bool = True) -> tuple[DataFrame, DataFrame]:
    """Suggested nodes of responses ``raw(id, raw)``.

    A response in which any item lacks a key is rejected as a whole.
    """
    j = F.col("_json")
    needed = ["name", "content", *(["suggested_parent"] if with_parent else [])]
    rows = computed_once(_parsed(raw), _all=F.when(_is_list(_field(j, "nodes")), _field(j, "nodes", "array<variant>")))
    reason = choose(
        [
            (j.isNull(), F.lit("not_json")),
            (~_kind(j).startswith("OBJECT") | _field(j, "nodes").isNull(), F.lit("missing_nodes")),
            (F.col("_all").isNull(), F.lit("nodes_not_list")),
            (F.exists("_all", lambda n: ~_has(n, *needed)), F.lit("missing_key")),
        ],
        F.lit(None).cast("string"),
    )
    rows = computed_once(rows, reason=reason)
    items = rows.where(F.col("reason").isNull()).select("id", F.posexplode("_all").alias("position", "n"))
    accepted = items.select("id", "position", *[_field(F.col("n"), c, "string").alias(c) for c in needed])
    return accepted, rows.where(F.col("reason").isNotNull()).select("id", "raw", "reason")


# --- prompts -------------------------------------------------------------------


def node_text(name: Column, content: Column) -> Column:
    """One node as prompt text; empty content is left out."""
    body = F.when(F.coalesce(content, F.lit("")) != "", F.concat(F.lit("\n" + V.PROMPT_CONTENT), content)).otherwise(F.lit(""))
    return F.concat(F.lit(V.PROMPT_NAME), name, body)


def prompt_head(question_types: list[str]) -> str:
    return V.PROMPT_TYPES_HEAD + V.PROMPT_TYPES_JOIN.join(question_types) + V.PROMPT_TYPES_TAIL


def build_prompts(
    nodes: DataFrame, question_types: list[str], order: DataFrame | None = None, *, part_chars: int = PART_CHARS
) -> DataFrame:
    """Prompt text of every live node, with its subtree if ``order`` is given.

    ``order`` is the result of ``preorder_rows``; the texts of a large subtree come in parts of at most
    ``part_chars`` characters, of which the first follows the prompt's head.
    """
    head = F.lit(prompt_head(question_types))
    own = node_text(F.col("name"), F.col("content"))
    if order is None:
        return live_nodes(nodes).select("owner_id", "id", F.concat(head, own).alias("prompt"))
    documents = subtree_documents(nodes, order, own, separator=V.PROMPT_SEPARATOR, part_chars=part_chars)
    return documents.select("owner_id", "id", "part", F.concat(F.when(F.col("part") == 0, head).otherwise(F.lit("")), F.col("text")).alias("prompt"))
