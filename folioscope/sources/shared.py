"""Folders that the driver and all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder under `spark.checkpoint.dir`, removed when the session's process ends. Where that isn't set, a session with local executors gets one
    of this machine; a cluster has no place to choose from, and must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        _files(spark, path).delete(_path(spark, path), True)
    except Exception:  # noqa: BLE001  the JVM is gone already
        return


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    files = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(_path(spark, path))] if files.exists(_path(spark, path)) else []


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
