"""Written intermediate tables: how iterative jobs cut their lineage.

A table written to the shared checkpoint folder survives the loss of any
executor, is computed exactly once, and gives the planner real sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local-mode session may go without the setting; it then gets one
    fresh folder per application.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="grovekeep-")
    return _local_roots[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _store(df: DataFrame, folder: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    observed = None
    if metrics:
        observed = Observation()
        df = df.observe(observed, *[c.alias(name) for name, c in metrics.items()])
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    return table, (observed.get if observed is not None else {})


def keep(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` out and read it back; ``metrics`` are aggregates observed
    during the write, so they cost no second job."""
    return _store(df, new_path(df.sparkSession, label), metrics)


def kept(df: DataFrame, label: str) -> DataFrame:
    return keep(df, label)[0]


class Work:
    """Written tables of one job that nothing needs once its result has been written.

    Leaving the ``with`` block removes them; tables that a lazy result still reads
    belong outside, to :func:`kept`.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._folders: list[str] = []

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        folder = new_path(self._spark, label)
        self._folders.append(folder)
        return _store(df, folder, {})[0]

    def __enter__(self) -> Work:
        return self

    def __exit__(self, *_: object) -> None:
        for folder in self._folders:
            _remove(self._spark, folder)


class Rounds:
    """Successive versions of one table of an iterative job.

    Writing a version removes the one before it, which nothing needs any more
    once the new one is complete; a long loop never holds more than two.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self._spark = spark
        self._label = label
        self._folder: str | None = None

    def write(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        folder, outdated = new_path(self._spark, self._label), self._folder
        table, seen = _store(df, folder, metrics)
        self._folder = folder
        if outdated is not None:
            _remove(self._spark, outdated)
        return table, seen


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
