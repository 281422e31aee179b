"""Exact integer k-means over dictionary-encoded subvectors.

Each chunk of vectors is encoded once, without loss: neighbouring dimensions form blocks, and a vector
is its codes in the blocks' dictionaries of distinct subvectors. In every round the squared distance of
each distinct subvector to each centroid's part is computed once; a vector's distance is the sum of
those of its codes. A cluster's sum is found the same way, from how often it holds each code.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.packed import least_type, pack, unpack
from tidemark.llm.vectors import gathered, whole

#: A block takes in the next dimension while its chunk has at least this many vectors for each distinct
#: subvector, so that a dictionary is worth its table.
VECTORS_PER_ENTRY = 4
#: Distances that are held at once.
HELD = 1 << 22


def encode(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(entries, codes) of each block of dimensions, from the first on: ``entries[codes]`` are its columns."""
    singles = [np.unique(column, return_inverse=True) for column in x.T]
    blocks = []
    entries = codes = None
    for values, places in singles:
        if entries is not None:
            pairs, both = np.unique(codes * len(values) + places, return_inverse=True)
            if len(pairs) * VECTORS_PER_ENTRY <= len(x):
                entries, codes = np.c_[entries[pairs // len(values)], values[pairs % len(values)]], both
                continue
            blocks.append((entries, codes))
        entries, codes = values[:, None], places
    return blocks + [(entries, codes)] if entries is not None else blocks


def _encoded(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in gathered(batches, width):
            blocks = encode(x)
            yield pa.RecordBatch.from_pydict({
                "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                "widths": pa.array([[entries.shape[1] for entries, _ in blocks]], pa.list_(pa.int32())),
                "entries": pa.array([[pack(entries.ravel().view(np.uint64)) for entries, _ in blocks]], pa.list_(pa.binary())),
                "codes": pa.array([[pack(least_type(codes)) for _, codes in blocks]], pa.list_(pa.binary())),
            })
    return work


def decoded(row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(unpack(e).view(np.int64).reshape(-1, w), unpack(c).astype(np.int64)) for w, e, c in zip(row["widths"], row["entries"], row["codes"])]


def nearest(blocks: list, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; ties to the smaller number."""
    tables, at = [], 0
    for entries, _ in blocks:
        part = centroids[:, at:at + entries.shape[1]]
        tables.append(sum((entries[:, i, None] - part[:, i]) ** 2 for i in range(part.shape[1])))
        at += entries.shape[1]
    rows, step = len(blocks[0][1]), max(1, HELD // len(centroids))
    cluster, distance = np.empty(rows, np.int32), np.empty(rows, np.int64)
    for lo in range(0, rows, step):
        total = tables[0][blocks[0][1][lo:lo + step]]
        for table, (_, codes) in zip(tables[1:], blocks[1:]):
            total += table[codes[lo:lo + step]]
        cluster[lo:lo + step] = total.argmin(1)
        distance[lo:lo + step] = total.min(1)
    return cluster, distance


def _sums(centroids: np.ndarray):
    """Rows (cluster, part, value) of a task: part -2 counts vectors, -1 adds up distances, the others
    the components of that number."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks, k = decoded(row), len(centroids)
                cluster, distance = nearest(blocks, centroids)
                columns = [np.bincount(cluster, minlength=k), np.array([distance[cluster == c].sum() for c in range(k)])]
                for entries, codes in blocks:
                    uses = np.bincount(cluster.astype(np.int64) * len(entries) + codes, minlength=k * len(entries))
                    columns += list((uses.reshape(k, -1) @ entries).T)
                found = np.array(columns, np.int64)
                parts = np.repeat(np.arange(-2, len(found) - 2, dtype=np.int32), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(k, dtype=np.int32), len(found))), pa.array(parts), pa.array(found.ravel())], ["cluster", "part", "value"])
    return work


def _assigned(centroids: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cluster, distance = nearest(decoded(row), centroids)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])
    return work


def _totals(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact totals as Python numbers: a row per cluster, with its count, inertia and component sums."""
    found = chunks.select("ids", "widths", "entries", "codes").mapInArrow(_sums(centroids), "cluster int, part int, value long")
    totals = np.zeros((len(centroids), centroids.shape[1] + 2), object)
    for cluster, part, value in found.groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
        totals[cluster, part + 2] = int(value)
    return totals


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3,
            vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): k-means of floor(scale * component).

    Kept are vectors of exactly ``size`` components, none null or non-finite; every kept row counts, also
    repeated ones and those with a null id. The first centroids are the kept rows of least sha256 of
    "seed:vec_id" (rows of one id by their vectors; rows without an id never), as many as there are up
    to ``k``. A round assigns each vector to the nearest centroid by squared distance, ties to the smaller
    number, then moves each centroid that has vectors to the floor of their mean. ``centroid`` is the
    final one; distances, inertias and centroids are exact whole numbers. Without kept rows, or without an
    id among them, the result is empty. A component so large that a distance could pass a long is an error.

    Vectors are read and encoded once into a written table of chunks of bounded size, in the tasks that
    scan them, without a shuffle. A round is one map over that table; what it sends on is one number
    per chunk, cluster and dimension, added up by Spark, so the driver sees k * size sums. Centroids
    travel with the plan: k * size numbers, whatever the number of vectors.
    """
    spark = vectors.sparkSession
    limit = math.isqrt(2**62 // max(size, 1)) // 2
    rows = whole(vectors.filter(F.size(vector) == size), vector, scale, limit)
    first = rows.filter("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = first.orderBy("hash", "x").limit(k).collect()
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first or not size:
        return spark.createDataFrame([], result)
    chunks = written(rows.mapInArrow(_encoded(size), "ids array<long>, widths array<int>, entries array<binary>, codes array<binary>"), "uncompressed")
    centroids = np.array([r["x"] for r in sorted(first, key=lambda r: (r["hash"], r["x"]))], np.int64)
    for _ in range(rounds):
        totals = _totals(chunks, centroids)
        centroids = np.array([[s // row[0] for s in row[2:]] if row[0] else old.tolist() for row, old in zip(totals, centroids)], np.int64)
    inertias = [int(row[1]) for row in _totals(chunks, centroids)]
    found = chunks.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long")
    place = F.col("cluster") + 1
    return found.withColumns({
        "cluster_inertia": F.element_at(F.array(*[F.lit(i).cast("long") for i in inertias]), place),
        "inertia": F.lit(sum(inertias)).cast("long"),
        "centroid": F.element_at(F.array(*[F.array(*[F.lit(c).cast("long") for c in row]) for row in centroids.tolist()]), place)})

