"""Folder access through Spark's own file system layer, so that any shared store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, without hidden and marker files; empty when the folder is not there."""
    fs, p = _open(spark, path)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if not n.startswith(("_", ".")))


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` whose write has ended, by one listing."""
    fs, _ = _open(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS"))
    return sorted(s.getPath().getParent().getName() for s in found or [])


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _open(spark, path)
    fs.delete(p, True)


def size_of(spark: SparkSession, path: str) -> int:
    fs, p = _open(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0
