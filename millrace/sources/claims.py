"""Numbers that several writers of one folder draw without two getting the same."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def claim(spark: SparkSession, path: str) -> int:
    """The next number of ``path``, from 1: a file by that name is created, which succeeds for one writer only."""
    fs, at = file_system(spark, f"{path}/_numbers")
    fs.mkdirs(at)
    taken = [int(s.getPath().getName()) for s in fs.listStatus(at)]
    n = max(taken, default=0) + 1
    while not fs.createNewFile(file_system(spark, f"{path}/_numbers/{n}")[1]):
        n += 1
    for old in taken:  # only the last matters
        if old < n - 100:
            fs.delete(file_system(spark, f"{path}/_numbers/{old}")[1], False)
    return n
