"""What the operators of this subpackage share: staged tables and small helpers."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

FEW_IDS = 700_000  # about 40 MB in a broadcast of ids alone

_own: dict[str, str] = {}
_stages: list[Stage] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only where that setting is absent and the master is local, as in tests, a temporary folder is made once per
    application; on a cluster, where no executor would see it, its absence is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return _own[sc.applicationId]


class Stage:
    """Tables of one operator call, written to the shared folder to cut lineage.

    A lost executor costs a re-read of these files, not a recomputation.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/keyloom/{name}-{uuid.uuid4().hex}"
        _stages.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def put(self, table: str, df: DataFrame) -> DataFrame:
        """Write a table and return a frame that reads it."""
        self.write(table, df)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def write(self, table: str, df: DataFrame, by: tuple[str, ...] = ()) -> None:
        """Write a table; the shuffle files of this job go as soon as it has ended, as nothing reads them again."""
        with _setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(self.path(table))

    def drop(self, table: str = "") -> None:
        """Remove a table that nothing will read again, or all tables of this call."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table).rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager:
    """Rows of an Arrow batch, at most, for jobs that run inside: few where a row may hold long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    return _setting(spark, key, str(min(rows, before) if before > 0 else rows))


def integral(docs: DataFrame, column: str) -> None:
    """Raise where ids are no integers: results carry them as such."""
    kind = docs.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{column} must hold integers, not {kind.simpleString()}")


def without(docs: DataFrame, ids: DataFrame, stage: Stage) -> DataFrame:
    """The rows of ``docs`` whose id is none of ``ids``, one column that ``docs`` has too; a null there stands for rows without an id.

    The ids are staged and counted first: Spark would shuffle whole texts by what it guesses of their number.
    Only where they are more than ``FEW_IDS`` the texts are shuffled.
    """
    (name,) = ids.columns
    gone = stage.put("gone", ids.distinct())
    n, known = gone.agg(F.count("*"), F.count(name)).first()
    kept = docs.filter(F.col(name).isNotNull()) if n > known else docs
    gone = gone.filter(F.col(name).isNotNull())
    return kept.join(F.broadcast(gone) if known <= FEW_IDS else gone, name, "left_anti")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@atexit.register
def release() -> None:
    """Remove the staged tables of all calls so far; their results must have been read. Runs at exit, too."""
    while _stages:
        stage = _stages.pop()
        if stage.spark.sparkContext._jsc is not None:
            with contextlib.suppress(Py4JError, OSError):  # the JVM may have gone
                stage.drop()
