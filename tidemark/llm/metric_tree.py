"""Exact search for the largest inner products: M-trees searched best first.

Whole-number vectors get one more coordinate that makes all their lengths equal, and queries a zero
there, so that the largest inner product is the nearest neighbour by Euclidean distance, a metric.
Vectors go to the nearest of a bounded number of top routing objects, each with its covering radius,
and below it to parts of bounded size; each part is an M-tree of pages. An inner page's entry has a
routing object, its covering radius and its distance to the page's own routing object (its parent
distance); a leaf's entry has a vector and its parent distance. By the triangle inequality

* an entry of parent distance p is no nearer to the query than |d(query, parent) - p| - radius, which
  skips it without computing its distance;
* the page below an entry holds nothing nearer than d(query, entry) - radius, which orders the pages
  still to visit and ends the search once that passes the farthest result.

A query first searches one part below the top routing object that promises most. What it finds there
bounds its search of the other parts, and spares it those whose covering radius is out of reach.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.vectors import common_length, matrix, whole

#: Vectors of a part, entries of a page, top routing objects at most, queries that visit a part together.
PART, PAGE, TOPS, QUERIES = 8192, 256, 1024, 1 << 16
#: Tasks that search at most; each takes its parts one after the other.
TASKS = 20_000
#: Products below this are exact as doubles; up to ``LIMIT`` squared per vector they are as longs.
EXACT, LIMIT = 2**52, 2**60
#: Distances are trusted up to this part of the longest vector's length.
SLACK = 1e-6


class Metric:
    """Distances between vectors whose added coordinate makes all lengths ``length``."""

    def __init__(self, squared: int):
        self.squared, self.kind = squared, np.float64 if squared < EXACT else np.int64
        self.slack = SLACK * max(1.0, np.sqrt(float(squared)))

    def rest(self, x: np.ndarray) -> np.ndarray:
        lengths = (x * x).sum(-1)
        return np.sqrt(np.maximum(self.squared - lengths, 0).astype(float))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the rows of ``a`` to those of ``b``."""
        products = a.astype(float) @ b.astype(float).T + self.rest(a)[:, None] * self.rest(b)
        return np.sqrt(np.maximum(2 * float(self.squared) - 2 * products, 0))

    def of_scores(self, scores, length: float):
        """Distances to a query of squared ``length`` from inner products with it."""
        return np.sqrt(np.maximum(length + float(self.squared) - 2.0 * scores, 0))


def pages(ids: np.ndarray, x: np.ndarray, root: np.ndarray, metric: Metric, size: int) -> Iterator[dict]:
    """Bulk load: the pages of one tree below the routing object ``root``, page 0 on top.

    Members of a page too large are dealt to the nearest of some of them, taken at even steps; where all
    go to one (equal vectors) they are dealt out in order.
    """
    count = 1
    todo = [(0, np.arange(len(ids)), root)]
    while todo:
        number, members, routing = todo.pop()
        if len(members) <= size:
            parent = metric.between(x[members], routing[None])[:, 0]
            yield {"page": number, "leaf": True, "ids": ids[members], "objects": x[members], "parent": parent}
            continue
        wide = min(size, -(-2 * len(members) // size))
        picks = x[members[np.arange(wide) * len(members) // wide]]
        away = metric.between(x[members], picks)
        group = away.argmin(1)
        if (group == group[0]).all():
            group = np.arange(len(members)) * wide // len(members)
        used = np.unique(group)
        children = np.arange(count, count + len(used))
        count += len(used)
        radius = np.array([away[group == g, g].max() for g in used])
        yield {"page": number, "leaf": False, "ids": children, "objects": picks[used], "radius": radius,
               "parent": metric.between(picks[used], routing[None])[:, 0]}
        todo += [(child, members[group == g], picks[g]) for child, g in zip(children.tolist(), used)]


class Tree:
    """Pages of one part by number, searched best first. ``computed`` counts distances to stored objects."""

    def __init__(self, root: np.ndarray, metric: Metric):
        self.root, self.metric, self.pages, self.computed = root, metric, {}, 0

    def add(self, page: dict) -> None:
        self.pages[page["page"]] = page | {"objects": page["objects"].astype(self.metric.kind)}

    def search(self, own: int, query: np.ndarray, count: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best ``count`` with a score of at least ``floor``, other than ``own``."""
        metric, length = self.metric, float((query.astype(float) ** 2).sum())
        q = query.astype(metric.kind)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = floor
        reach = np.inf if least is None else float(metric.of_scores(least, length)) + metric.slack
        queue = [(0.0, 0, float(metric.of_scores(float(self.root.astype(float) @ query), length)))]
        while queue:
            bound, number, middle = heapq.heappop(queue)
            if bound > reach:
                break
            page = self.pages[number]
            near = np.abs(middle - page["parent"]) - (0 if page["leaf"] else page["radius"]) <= reach
            objects = page["objects"][near]
            self.computed += len(objects)
            found = objects @ q
            if not page["leaf"]:
                away = metric.of_scores(found, length)
                bounds = away - page["radius"][near]
                for b, child, d in zip(bounds.tolist(), page["ids"][near].tolist(), away.tolist()):
                    if b <= reach:
                        heapq.heappush(queue, (max(b, 0.0), child, d))
                continue
            good = page["ids"][near] != own
            if least is not None:
                good &= found >= least
            if not good.any():
                continue
            ids = np.concatenate([ids, page["ids"][near][good]])
            scores = np.concatenate([scores, found[good].astype(np.int64)])
            best = np.lexsort((ids, -scores))[:count]
            ids, scores = ids[best], scores[best]
            if len(ids) == count:
                least = int(scores[-1])
                reach = float(metric.of_scores(least, length)) + metric.slack
        return ids, scores


class Tops:
    """The top routing objects: at most ``TOPS``; with radii and parts once the vectors are dealt."""

    def __init__(self, objects: np.ndarray, metric: Metric):
        self.objects, self.metric = objects, metric
        self.radius = self.parts = self.first = None

    def assigned(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = self.metric.between(matrix(batch.column("x"), self.objects.shape[1]), self.objects)
            top = away.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(top.astype(np.int32)), pa.array(away[np.arange(len(top)), top])],
                ["vec_id", "x", "top", "away"])

    def dealt(self, tops: list, part: int) -> int:
        """Takes (top, vectors, radius) rows in; returns the number of parts."""
        self.radius, self.parts = np.zeros(len(self.objects)), np.zeros(len(self.objects), np.int64)
        for top, rows, radius in tops:
            self.radius[top], self.parts[top] = radius, -(-rows // part)
        self.first = np.cumsum(self.parts) - self.parts
        return int(self.parts.sum())

    def of_part(self, part: int) -> np.ndarray:
        return self.objects[np.searchsorted(self.first, part, "right") - 1]

    def visits(self, others: bool):
        """Rows (part, query_id, x, floor): the part each query searches first, or all others in reach."""
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            used = np.flatnonzero(self.parts)
            for batch in batches:
                asked = matrix(batch.column("x"), self.objects.shape[1])
                floors, home = batch.column("floor").to_pylist(), batch.column("home").to_numpy()
                products = asked.astype(float) @ self.objects[used].astype(float).T
                lengths = (asked.astype(float) ** 2).sum(1)
                bound = self.metric.of_scores(products, lengths[:, None]) - self.radius[used]
                first = used[bound.argmin(1)]
                mine = self.first[first] + home % self.parts[first]
                rows, parts = np.arange(len(asked)), [[p] for p in mine.tolist()]
                if others:
                    reach = [np.inf if f is None else float(self.metric.of_scores(f, n)) + self.metric.slack for f, n in zip(floors, lengths)]
                    parts = [[p for t in used[b <= r] for p in range(self.first[t], self.first[t] + self.parts[t]) if p != m]
                             for b, r, m in zip(bound, reach, mine)]
                for lo in range(0, len(asked), 1024):  # some rows become as many as there are parts
                    rows = np.repeat(np.arange(lo, lo + len(parts[lo:lo + 1024])), [len(p) for p in parts[lo:lo + 1024]])
                    if len(rows):
                        taken = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p for ps in parts[lo:lo + 1024] for p in ps], pa.int64()), taken.column("vec_id"), taken.column("x"), taken.column("floor")],
                            ["part", "vec_id", "x", "floor"])
        return work


_PAGE = "part long, page int, leaf boolean, ids binary, objects binary, parent binary, radius binary"


def _built(tops: Tops, size: int):
    """Rows (part, vec_id, x), those of a part together, to its pages."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(part, held):
            ids, x = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            for page in pages(ids, x, tops.of_part(part), tops.metric, size):
                columns = {"part": [part], "page": [page["page"]], "leaf": [page["leaf"]]} | {
                    k: [np.ascontiguousarray(page[k]).tobytes() if k in page else None] for k in ("ids", "objects", "parent", "radius")}
                yield pa.RecordBatch.from_pydict(columns, pa.schema([
                    ("part", pa.int64()), ("page", pa.int32()), ("leaf", pa.bool_()), ("ids", pa.binary()), ("objects", pa.binary()), ("parent", pa.binary()), ("radius", pa.binary())]))

        held, at = [], None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1], True])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if parts[lo] != at and held:
                    yield from tree(at, held)
                    held = []
                at = int(parts[lo])
                rows = batch.slice(lo, hi - lo)
                held.append((rows.column("vec_id").to_numpy(), matrix(rows.column("x"), tops.objects.shape[1])))
        if held:
            yield from tree(at, held)
    return work


def _searched(tops: Tops, count: int):
    """Rows sorted so that a part's pages come before its queries, to results."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, at, tree = tops.objects.shape[1], None, None
        for batch in batches:
            results = []
            for row in batch.to_pylist():
                if row["key"] != at:
                    at, tree = row["key"], Tree(tops.of_part(row["part"]), tops.metric)
                if row["objects"] is not None:
                    page = {"page": row["page"], "leaf": row["leaf"], "ids": np.frombuffer(row["ids"], np.int64), "parent": np.frombuffer(row["parent"])}
                    page["objects"] = np.frombuffer(row["objects"], np.int64).reshape(-1, width)
                    tree.add(page | ({} if row["leaf"] else {"radius": np.frombuffer(row["radius"])}))
                else:
                    results.append((row["vec_id"], *tree.search(row["vec_id"], np.array(row["x"], np.int64), count, row["floor"])))
            if results:
                asked = np.repeat([r[0] for r in results], [len(r[1]) for r in results]).astype(np.int64)
                found, scores = (np.concatenate([r[k] for r in results]) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])
    return work


def _search(stored: DataFrame, visits: DataFrame, tops: Tops, count: int, parts: int, blocks: int) -> DataFrame:
    """Visits meet the pages of their part, at most ``QUERIES`` or so of them in one group."""
    pages_of = stored.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select(
        (F.col("part") * blocks + F.col("block")).alias("key"), "part", "page", "leaf", "ids", "objects", "parent", "radius",
        F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<long>").alias("x"), F.lit(None).cast("long").alias("floor"))
    asked = visits.select(
        (F.col("part") * blocks + F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).alias("key"), "part", "vec_id", "x", "floor")
    tasks = min(parts * blocks, TASKS)
    together = pages_of.unionByName(asked, allowMissingColumns=True).repartitionById(tasks, F.pmod("key", F.lit(tasks)).cast("int"))
    together = together.sortWithinPartitions("key", F.col("objects").isNull(), "page", "vec_id")
    return together.mapInArrow(_searched(tops, count), "query_id long, vec_id long, score long")


def top_products(vectors: DataFrame, is_query: Column, count: int = 5, scale: int = 256, vector: str = "embedding",
                 part: int = PART, page: int = PAGE, tops: int = TOPS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``count`` rows of largest inner product, exactly.

    Components c count as floor(scale * c). ``is_query`` picks the queries, each searched against all
    rows but those with its own id; ties go to the smaller vec_id. Vectors that are null, empty, or hold
    null or non-finite components take no part, nor do null ids and vectors of another length than most
    (between equally many, the shorter). Of repeated query ids one is searched, the one whose vector
    sorts first; repeated rows are all candidates. Without usable rows or queries the result is empty.
    Vectors too long for exact products in a long are an error.

    Of equal vectors only the ``count`` + 1 smallest ids, and of repeated rows ``count``, can be among the
    best. The others are left out by partial aggregates and limits before each shuffle, so that nothing is
    lost and no vector is hot. A top routing object with more than ``part``
    vectors has several parts by hash. A visit is one row per query and part in reach: where distances
    tell little apart that is queries * vectors / ``part`` rows, which exactness costs there.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    marked = vectors.select("vec_id", F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = whole(marked, "vector", scale, 1 << 30, keep=["is_query"]).filter("vec_id is not null and size(x) > 0")
    width = common_length(rows)
    if width is None:
        return spark.createDataFrame([], result)
    rows = written(rows.filter(F.size("x") == width))
    squared, asked = rows.agg(F.max(F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c * c)), F.count_if("is_query")).first()
    if squared > LIMIT:
        raise ValueError(f"vectors of squared length {squared} are too long for exact products")
    if not asked:
        return spark.createDataFrame([], result)
    queries = rows.filter("is_query").groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("home", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)))
    # of equal vectors the smallest ids, one more than asked for as one may be the query's own
    ids = rows.groupBy("x", "vec_id").agg(F.least(F.count("*"), F.lit(count)).alias("times"))
    ids = ids.withColumn("n", F.row_number().over(W.partitionBy("x").orderBy("vec_id"))).filter(F.col("n") <= count + 1)
    entries = written(ids.select("vec_id", "x", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("vec_id", "x"))
    total = entries.count()
    metric = Metric(int(squared))
    spread = entries.groupBy("x").agg(F.xxhash64("x").alias("h")).orderBy("h", "x").limit(min(tops, -(-total // part))).collect()
    top = Tops(np.array([r["x"] for r in spread], np.int64), metric)
    dealt = written(entries.mapInArrow(top.assigned, "vec_id long, x array<long>, top int, away double"))
    parts = top.dealt(dealt.groupBy("top").agg(F.count("*"), F.max("away")).collect(), part)
    firsts, counts = (F.array(*[F.lit(int(v)) for v in values]) for values in (top.first, np.maximum(top.parts, 1)))
    place = F.element_at(firsts, F.col("top") + 1) + F.pmod(F.xxhash64("vec_id", "x"), F.element_at(counts, F.col("top") + 1))
    tasks = min(parts, TASKS)
    placed = dealt.select(place.cast("long").alias("part"), "vec_id", "x").repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int"))
    stored = written(placed.sortWithinPartitions("part", "vec_id").mapInArrow(_built(top, page), _PAGE))

    blocks = max(1, -(-asked // QUERIES))
    visit = "part long, vec_id long, x array<long>, floor long"
    first = queries.withColumn("floor", F.lit(None).cast("long"))
    first = first.mapInArrow(top.visits(others=False), visit)
    near = written(_search(stored, first, top, count, parts, blocks))
    floors = near.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= count)
    bounded = queries.join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left").select("vec_id", "x", "home", "floor")
    far = _search(stored, bounded.mapInArrow(top.visits(others=True), visit), top, count, parts, blocks)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = near.union(far).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= count)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
