"""A folder of numbered files, each created by one writer only: the order of its loads."""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    folder, system = _folder(spark, path)
    return system.exists(folder)


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers that are taken, in order; none where the folder is not there."""
    folder, system = _folder(spark, path)
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n.split(".")[0]) for n in names if n[0].isdigit())


def create(spark: SparkSession, path: str, number: int, lines: Iterable[str]) -> bool:
    """Write the file of a number; False if another writer took it first.

    This needs a store that creates a file at most once. A writer that is cut off leaves part of the
    lines, so the last one has to say that it is the last.
    """
    folder, system = _folder(spark, path)
    try:
        out = system.create(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}.json"), False)
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    try:
        out.write(bytearray("".join(line + "\n" for line in lines).encode()))
    finally:
        out.close()
    return True
