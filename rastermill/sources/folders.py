"""Folders of stored tables, through the file system that Spark uses for their path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def folder_names(spark: SparkSession, path: str, finished: bool = False) -> list[str]:
    """Names of the folders below ``path``; with ``finished`` only those that a job has written to its end."""
    files, where = _place(spark, path)
    if not files.exists(where):
        return []
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [f.getPath() for f in files.listStatus(where) if f.isDirectory()]
    return sorted(f.getName() for f in found if not finished or files.exists(mark(f, "_SUCCESS")))


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, where = _place(spark, path)
    return files.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder; a table may also be a single file."""
    files, where = _place(spark, path)
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Take away a folder that nothing reads any more."""
    files, where = _place(spark, path)
    files.delete(where, True)
