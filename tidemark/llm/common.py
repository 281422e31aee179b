"""Helpers shared by the operators: shared folder, written tables, splits and components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, else the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The rows of ``df`` written to the shared folder and read back: lineage ends there, and lost
    executors cost no recomputation.  Columns of packed bytes need no further ``compression``."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id, which no fold holds out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus), F.lit(-1))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column of strings with null as the empty string."""
    return [t or "" for t in batch.column(name).to_pylist()]


def text_batches(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text, one row at least, so that Python copies stay few."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(lengths + 64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def chunk_numbers() -> Iterator[int]:
    """Numbers for the chunks that this task makes, unique over all tasks of its stage. A task that makes
    more than there are numbers for fails, and its input has to be read in smaller splits."""
    partition = TaskContext.get().partitionId()
    yield from range(partition << 12, (partition + 1) << 12)
    raise ValueError("a task makes over 4,096 chunks: read the input in smaller splits")


class Places(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = place = len(self)
        return place


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): (node, component), where component
    is the smallest node of its component. Alternating large-star and small-star rounds, each a few
    aggregations and joins whose result is written to the shared folder; hub nodes are pre-aggregated
    by partial minima, and the joins have one row per node on one side.
    """
    def mark(frame: DataFrame):
        return frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    current = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(current)
    if before[0] == 0:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        current = written(small.filter("a <> b").distinct())
        after = mark(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = current.groupBy("a").agg(F.min("b").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.select(F.col("a").alias("node"), "component").union(roots)
