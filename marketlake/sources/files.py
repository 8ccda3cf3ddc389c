"""Folders on any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path`` that a job has written to its end, sorted."""
    system, at = _path(spark, path)
    if not system.exists(at):
        return []
    names = [status.getPath().getName() for status in system.listStatus(at) if status.isDirectory()]
    done = [n for n in names if system.exists(_path(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(done)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of all folders under ``path``, sorted."""
    system, at = _path(spark, path)
    if not system.exists(at):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(at) if status.isDirectory())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of the library's own tables, if it is there."""
    system, at = _path(spark, path)
    system.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file or folder, making the folders above it."""
    system, at = _path(spark, old)
    to = _path(spark, new)[1]
    system.mkdirs(to.getParent())
    if not system.rename(at, to):
        raise OSError(f"can not rename {old}")
