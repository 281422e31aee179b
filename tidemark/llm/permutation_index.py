"""Nearest neighbours by largest inner product: a permutation index with pivot inverted files.

A vector is represented by its nearest pivots in order. Vectors are dealt to blocks of bounded size;
in each, an inverted file lists under every pivot the vectors that have it among their nearest, with
its rank. A query walks the lists of its own nearest pivots, which gives its footrule distance (summed
rank differences, a pivot outside the list counting as one past its end) to all it shares a pivot with.
The nearest by footrule are reranked by their true inner products. Many pivots with short lists spare
most vectors: at 1,024 pivots, 64 of them kept, a query meets four postings for each vector of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Pivots come from a sample of the vectors, ``POOL`` times as many as pivots, those of least hash; the
#: index itself holds every vector. A pivot closer to an earlier one than this cosine is taken last.
PIVOTS, NEAREST = 1024, 64
POOL, APART = 4, 0.8
#: Of a block of n vectors, this many times the root of n are reranked, at every size: the part that holds
#: the nearest falls as blocks grow.
RERANK = 10
BLOCK, QUERY_BLOCK = 16384, 1 << 16
#: Sums of products taken in another order agree within this part of the vectors' lengths.
ROUNDING = 1e-12
#: Vectors whose likeness to all pivots is held at once.
SLICE = 2048


def usable(vector: Column) -> Column:
    """Not null, not all zero, and without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Block:
    """Vectors in order of their ids with their inverted files."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, norm: float):
        self.ids, self.vectors, self.norm = ids, vectors, norm
        # One more coordinate makes all lengths equal, so nearest pivots order by inner product.
        rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0))
        pivot_rest = np.sqrt(np.maximum(norm**2 - (pivots**2).sum(1), 0))
        order = np.concatenate([nearest(vectors[at:at + SLICE] @ pivots.T + rest[at:at + SLICE, None] * pivot_rest) for at in range(0, len(ids), SLICE)])
        self.pivots, self.width = pivots, order.shape[1]
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.member = (by_pivot // self.width).astype(np.int32)
        self.rank = (by_pivot % self.width).astype(np.int32)
        self.start = np.searchsorted(order.ravel()[by_pivot], np.arange(len(pivots) + 1))

    def search(self, own: int, query: np.ndarray, pivots: np.ndarray, count: int, rerank: float):
        """(ids, scores) of the best ``count`` of those reranked, other than ``own``."""
        n = len(self.ids)
        lists = [slice(self.start[p], self.start[p + 1]) for p in pivots]
        members = np.concatenate([self.member[s] for s in lists])
        ranks = np.concatenate([np.maximum(self.rank[s], i) for i, s in enumerate(lists)])
        # Footrule = a constant less twice this sum over shared pivots.
        shared = np.bincount(members, self.width - ranks, n).astype(np.int64)
        keep = int(np.ceil(rerank * np.sqrt(n))) + 1
        found = np.arange(n)
        if keep < n:  # of equal footrules, the smaller ids
            found = np.sort(np.argpartition(shared * -n + found, keep)[:keep])
        found = found[self.ids[found] != own]
        rough = self.vectors[found] @ query
        if len(found) > count:
            least = np.partition(rough, len(rough) - count)[len(rough) - count]
            found = found[rough >= least - ROUNDING * self.norm**2]
        scores = (self.vectors[found] * query).sum(1)
        best = np.lexsort((self.ids[found], -scores))[:count]
        return self.ids[found][best], scores[best]


def nearest(likeness: np.ndarray) -> np.ndarray:
    """Each row's columns from the largest value on, as many as a pivot list holds; ties by column."""
    width = min(NEAREST, likeness.shape[1])
    if width < likeness.shape[1]:
        least = np.partition(likeness, -width, axis=1)[:, -width, None]
        # of columns equal to the least that is kept, the first ones
        above, equal = likeness > least, likeness == least
        kept = above | (equal & (np.cumsum(equal, axis=1) <= width - above.sum(1)[:, None]))
        columns = np.nonzero(kept)[1].reshape(len(likeness), width)
    else:
        columns = np.tile(np.arange(width), (len(likeness), 1))
    order = np.argsort(-np.take_along_axis(likeness, columns, 1), axis=1, kind="stable")
    return np.take_along_axis(columns, order, 1)


def spread(pool: np.ndarray, count: int) -> np.ndarray:
    """``count`` vectors of the pool, those first that are no close neighbours of one taken before:
    many pivots of one crowded place would move together in every permutation and drown the others."""
    unit = pool / np.linalg.norm(pool, axis=1, keepdims=True)
    taken, left = [], []
    for i in range(len(pool)):
        near = bool(taken) and (unit[taken] @ unit[i]).max() > APART
        (left if near else taken).append(i)
        if len(taken) == count:
            break
    return pool[(taken + left)[:count]]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _search(pivots: np.ndarray, norm: float, count: int, rerank: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, block = [], None, None
        for batch in batches:
            group = batch.column("block").to_numpy() * 2 + batch.column("is_query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(lo, hi - lo)
                ids, vectors = part.column("vec_id").to_numpy(), _vectors(part.column("vector"))
                key = int(group[lo]) // 2
                if key != at:
                    held, at, block = [], key, None
                if group[lo] % 2 == 0:
                    held.append((ids, vectors))
                    continue
                if not held:
                    continue
                if block is None:
                    block = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pivots, norm)
                mine = np.concatenate([nearest(vectors[at:at + SLICE] @ pivots.T) for at in range(0, len(ids), SLICE)])
                results = [block.search(i, v, order, count, rerank) for i, v, order in zip(ids.tolist(), vectors, mine)]
                asked = np.repeat(ids, [len(r[0]) for r in results])
                found, scores = (np.concatenate([r[k] for r in results]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])
    return work


def search(vectors: DataFrame, is_query: Column, count: int = 20, vector: str = "embedding", pivots: int = PIVOTS,
           rerank: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``count`` rows of largest inner product found.

    ``vectors``: (vec_id, ``vector``); ``is_query`` picks the queries, each searched against all rows
    but those with its own id. Scores are inner products in double precision of the vectors as given;
    ties go to the smaller vec_id. Vectors that are not ``usable``, have a null id, or another length
    than most (between equally many, the shorter) take no part. Of repeated query ids one is searched,
    the one whose vector sorts first; repeated rows are all candidates. What is found is most of the
    nearest, not all: a ``rerank`` of the root of the block's size makes it exact.

    Vectors are hashed to blocks, so copies and common directions spread evenly. Each block is indexed
    once per ``QUERY_BLOCK`` queries, in one task; a task sends on at most ``count`` rows per query.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    rows = rows.filter("vec_id is not null").filter(usable(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not size:
        return vectors.sparkSession.createDataFrame([], result)
    rows = written(rows.filter(F.size("vector") == size[0][0]))
    norm, total, asked = rows.agg(
        F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))), F.count("*"), F.count_if("is_query")).first()
    hashes = rows.groupBy(F.xxhash64("vector").alias("h")).agg(F.min("vec_id").alias("vec_id")).orderBy("h").limit(POOL * pivots)
    chosen = rows.join(F.broadcast(hashes), (rows.vec_id == hashes.vec_id) & (F.xxhash64(rows.vector) == hashes.h), "left_semi")
    chosen = chosen.select(F.xxhash64("vector"), "vector").distinct().limit(2 * POOL * pivots).collect()
    chosen = spread(np.array([r[1] for r in sorted(chosen)], float), pivots)

    blocks, query_blocks = -(-total // BLOCK), max(1, -(-asked // QUERY_BLOCK))
    home = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")
    indexed = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"), home.alias("home"), F.lit(False).alias("is_query"), "vec_id", "vector")
    queries = rows.filter("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")
    queries = queries.select(
        part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("home"), F.lit(True).alias("is_query"), "vec_id", "vector")
    dealt = indexed.union(queries).withColumn("block", F.col("part") * blocks + F.col("home"))
    dealt = dealt.repartitionById(blocks * query_blocks, F.col("block")).sortWithinPartitions("block", "is_query", "vec_id")
    found = dealt.select("block", "is_query", "vec_id", "vector").mapInArrow(
        _search(chosen, float(norm), count, rerank), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
