"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import SparkSession

from millrace.sources.files import Files

_temporary: dict[str, Files] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own is set only in one-process runs."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(temporary(spark, tempfile.mkdtemp(prefix="millrace-")))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def temporary(spark: SparkSession, path: str) -> str:
    """A folder that goes when the driver ends, or before by drop()."""
    _temporary[path] = Files(spark)
    return path


def drop(path: str) -> None:
    files = _temporary.pop(path, None)
    if files is not None:
        files.delete(path)


@atexit.register
def _drop_all() -> None:
    for path in list(_temporary):
        try:
            drop(path)
        except Exception:  # the JVM has ended first: nothing can be reached any more
            return
