"""The folder that driver and executors share, for tables that outlive a query's plan."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is local, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return _own[sc.applicationId]


def mounted(path: str) -> str:
    """The plain path of a folder that all workers mount; ValueError for one that only Spark's file systems reach."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"{path!r}: a folder that workers mount is needed")
    return path
