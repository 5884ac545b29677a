"""Question bank: attempts, wrong answers, grading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import lookup
from .keyed import HOT_ROWS, last_rows, rank_rows, top_rows

OPTIONS_OBJECT = "reference_answer string, keywords array<string>"


def type_label(question_type: Column) -> Column:
    return lookup(question_type, V.TYPE_LABELS, V.DEFAULT_TYPE_LABEL)


def decode_options(options: Column) -> Column:
    """Options text as a struct; text that is not JSON stays in ``raw``."""
    parsed = F.try_parse_json(options)
    shape = F.schema_of_variant(parsed)
    is_list = F.coalesce(shape.startswith("ARRAY"), F.lit(False))
    is_object = F.coalesce(shape.startswith("OBJECT"), F.lit(False))
    return F.struct(
        F.when(is_list, F.try_variant_get(parsed, "$", "array<string>")).alias("choices"),
        F.when(is_object, F.try_variant_get(parsed, "$.reference_answer", "string")).alias("reference_answer"),
        F.when(is_object, F.try_variant_get(parsed, "$.keywords", "array<string>")).alias("keywords"),
        F.when(parsed.isNull(), options).alias("raw"),
    )


def latest_attempts(records: DataFrame, tie_break: list[str]) -> DataFrame:
    """Last attempt of every owner at every question."""
    names = ["question_id", "owner_id", "is_correct"]
    columns = list(dict.fromkeys([*names, "answered_at", *tie_break]))
    tried = records.where(F.col("question_id").isNotNull()).select(*columns)
    return last_rows(tried, ["question_id", "owner_id"], ["answered_at", *tie_break])


def question_latest_attempt(questions: DataFrame, records: DataFrame, tie_break: list[str]) -> DataFrame:
    """Questions with their owner's last attempt; the answer index is left out."""
    last = latest_attempts(records, tie_break).select(
        F.col("question_id").alias("id"), "owner_id", F.col("is_correct").alias("_correct")
    )
    return (
        questions.drop("correct_index")
        .join(last, ["id", "owner_id"], "left")
        .withColumn("answered", F.col("_correct").isNotNull())
        .withColumn("last_correct", F.coalesce("_correct", F.lit(False)))
        .drop("_correct")
    )


def question_list(questions: DataFrame, records: DataFrame, tie_break: list[str], *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every node's questions as its owner sees them: decoded options, type label, last attempt, and ``position``, newest first."""
    keys = questions.select("owner_id", "node_id", "id", "created_at")
    placed = rank_rows(keys, ["owner_id", "node_id"], [F.col("created_at").desc(), F.col("id").asc()], "position", hot_rows=hot_rows)
    seen = question_latest_attempt(questions, records, tie_break).join(placed.select("id", "owner_id", "position"), ["id", "owner_id"])
    return seen.withColumns({"options": decode_options(F.col("options")), "type_label": type_label(F.col("question_type"))})


def wrong_attempt_times(records: DataFrame) -> DataFrame:
    """Time of the last wrong attempt at every question, whoever made it."""
    wrong = records.where(~F.col("is_correct") & F.col("question_id").isNotNull())
    return wrong.groupBy(F.col("question_id").alias("id")).agg(F.max("answered_at").alias("last_wrong_at"))


def wrong_questions(questions: DataFrame, records: DataFrame, limit: int = V.DEFAULT_LIMIT) -> DataFrame:
    """Each owner's questions with a wrong attempt, the latest wrong first.

    Keys are ranked alone; the texts join the rows that remain.
    """
    keys = questions.select("owner_id", "id").join(wrong_attempt_times(records), "id")
    top = top_rows(keys, ["owner_id"], [F.col("last_wrong_at").desc(), F.col("id").asc()], limit)
    return questions.drop("correct_index", "owner_id").join(top, "id")


def question_detail(questions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Asked-for questions with their answer index; keys are (owner_id, id)."""
    return questions.join(wanted.select("owner_id", "id"), ["owner_id", "id"], "left_semi")


def questions_newest_first(questions: DataFrame) -> DataFrame:
    return questions.drop("correct_index").orderBy(F.col("created_at").desc(), F.col("id").asc())


def grade_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with ``graded``: short answers count as right, no choice as wrong."""
    key = questions.select(F.col("id").alias("question_id"), "question_type", "correct_index")
    graded = F.when(F.col("question_type") == "short_answer", F.lit(True)).otherwise(
        F.coalesce(F.col("chosen_index") == F.col("correct_index"), F.lit(False))
    )
    return answers.join(key, "question_id").withColumn("graded", graded)
