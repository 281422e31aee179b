"""Clustering, exact search and whitening of vectors against plain computations and SQL."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare, tables
from tidemark.llm import lanczos_whitening, metric_tree, queries, subvector_clusters, vectors

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, x string, cluster string, part string, vector string"
NAN, INF = float("nan"), float("inf")


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", None, "", "v") for i, v in rows], SCHEMA)


def odd_rows(width):
    """Rows that take no part, whatever the operator."""
    return [(9001, None), (9002, [NAN] * width), (9003, [INF] + [0.0] * (width - 1)), (9004, [None] + [1.0] * (width - 1))]


def random_rows(n, width, seed, spread=1.0):
    pick = np.random.default_rng(seed)
    return [(int(i), v) for i, v in enumerate((pick.normal(size=(n, width)) * spread).tolist())]


# --- clusters ------------------------------------------------------------------------------

def brute_clusters(rows, k, rounds, size, scale, seed):
    kept = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, x in kept:
            members[nearest(x)[1]].append(x)
        centroids = [[sum(column) // len(m) for column in zip(*m)] if m else c for m, c in zip(members, centroids)]
    found = [(i, *nearest(x)) for i, x in kept]
    inertia = {n: sum(d for _, d, m in found if m == n) for n in range(len(centroids))}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), tuple(centroids[n])) for i, d, n in found), key=str)


@pytest.mark.parametrize("held", [1 << 22, 50])
def test_clusters_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(vectors, "CHUNK", held)
    monkeypatch.setattr(subvector_clusters, "HELD", held)
    rows = random_rows(90, 6, 1) + random_rows(20, 6, 2, 0.01) + [(i, [0.5, -0.25, 0.0, 1.0, -0.0, 2.0]) for i in (500, 500, None, 501)] * 9
    rows += odd_rows(6) + [(7000, [1.0] * 5), (7001, []), (None, [0.1] * 6)]
    found = subvector_clusters.cluster(table_of(spark, rows), k=5, rounds=4, size=6, scale=16, seed=7).collect()
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in found), key=str)
    assert got == brute_clusters(rows, 5, 4, 6, 16, 7)


def test_dictionaries_lose_nothing_and_widen():
    pick = np.random.default_rng(3)
    for x in (pick.integers(-3, 3, (5000, 9)), pick.integers(-2**40, 2**40, (50, 4)), np.zeros((8, 5), np.int64), pick.integers(0, 9, (1, 3))):
        blocks = subvector_clusters.encode(x)
        assert (np.hstack([entries[codes] for entries, codes in blocks]) == x).all()
    widths = [entries.shape[1] for entries, _ in subvector_clusters.encode(pick.integers(0, 3, (5000, 9)))]
    assert sum(widths) == 9 and max(widths) > 3
    assert [e.shape[1] for e, _ in subvector_clusters.encode(pick.integers(0, 2**30, (500, 4)))] == [1] * 4


def test_clusters_of_few_rows_and_of_large_numbers(spark):
    assert subvector_clusters.cluster(table_of(spark, [])).collect() == []
    assert subvector_clusters.cluster(table_of(spark, odd_rows(64))).collect() == []
    assert subvector_clusters.cluster(table_of(spark, [(None, [1.0] * 64)])).collect() == []
    one = subvector_clusters.cluster(table_of(spark, [(4, [-0.0001] * 64)])).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.centroid) for r in one] == [(4, 0, 0, [-1] * 64)]
    large = [(i, [float(2**15 * (i - 3))] * 64) for i in range(5)]
    found = subvector_clusters.cluster(table_of(spark, large), k=2, rounds=1).collect()
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in found), key=str)
    assert got == brute_clusters(large, 2, 1, 64, 1024, 3)
    with pytest.raises(Exception, match="a vector has a component of"):
        subvector_clusters.cluster(table_of(spark, [(1, [1e30] * 64)])).collect()


# --- exact search --------------------------------------------------------------------------

def brute_products(rows, is_query, count, scale):
    good = [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    lengths = [len(x) for _, x in good]
    width = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    good = [(i, x) for i, x in good if len(x) == width]
    asked = {}
    for i, x in good:
        if is_query(i):
            asked[i] = min(asked.get(i, x), x)
    out = []
    for q, x in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:count])]
    return sorted(out)


CASES = {
    "sphere": random_rows(700, 5, 4),
    "groups": [(i, (np.array(v) * 0.05 + (i % 7) * np.eye(8)[i % 7] * 3).tolist()) for i, v in random_rows(600, 8, 5)],
    "copies": random_rows(60, 3, 6) + [(1000 + i, [1.0, 2.0, 3.0]) for i in range(300)] + [(5, [0.5, 0.5, 0.5])] * 4,
    "own copies": random_rows(15, 3, 10) + [(20, [4.0, 4.0, 4.0])] * 8 + [(i, [4.0, 4.0, 4.0]) for i in (31, 40, 41, 42, 43, 44, 45)] + [(33, [4.0, 4.0, 4.0])] * 9,
    "long": [(i, [c * 2.0**18 for c in v]) for i, v in random_rows(200, 4, 7)],
    "zeros": [(i, [0.0, 0.0]) for i in range(40)] + [(50, [1.0, 0.0]), (51, [-1.0, 0.0])],
}


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize("part,page,tops", [(8192, 256, 1024), (60, 8, 5)])
def test_top_products_against_brute_force(spark, monkeypatch, name, part, page, tops):
    monkeypatch.setattr(metric_tree, "QUERIES", 20 if part == 60 else 1 << 16)
    rows = CASES[name]
    rows = rows + odd_rows(len(rows[0][1])) + [(None, rows[0][1]), (9005, []), (9006, [1.0] * 11), rows[10], (20, rows[3][1])]
    found = metric_tree.top_products(table_of(spark, rows), F.col("vec_id") % 10 == 0, part=part, page=page, tops=tops).collect()
    assert sorted(map(tuple, found)) == brute_products(rows, lambda i: i % 10 == 0, 5, 256)


def test_stored_bounds_spare_distances():
    """In grouped vectors a search computes few of the distances, and still finds the best."""
    pick = np.random.default_rng(8)
    x = (pick.normal(size=(40, 16))[pick.integers(0, 40, 4000)] * 300 + pick.normal(size=(4000, 16)) * 10).astype(np.int64)
    metric = metric_tree.Metric(int((x * x).sum(1).max()))
    tree = metric_tree.Tree(x[0], metric)
    for page in metric_tree.pages(np.arange(4000), x, x[0], metric, 64):
        tree.add(page)
        assert len(page["objects"]) <= 64
    for q in range(0, 4000, 200):
        ids, scores = tree.search(q, x[q], 5, None)
        want = x @ x[q]
        want[q] = want.min() - 1
        assert ids.tolist() == np.lexsort((np.arange(4000), -want))[:5].tolist() and scores.tolist() == sorted(want.tolist(), reverse=True)[:5]
    assert tree.computed < 0.5 * 20 * 4000


def test_top_products_without_rows_or_queries(spark):
    none = F.lit(None).cast("boolean")
    assert metric_tree.top_products(table_of(spark, []), F.lit(True)).collect() == []
    assert metric_tree.top_products(table_of(spark, odd_rows(3)), F.lit(True)).collect() == []
    assert metric_tree.top_products(table_of(spark, random_rows(5, 3, 9)), none).collect() == []
    assert metric_tree.top_products(table_of(spark, random_rows(1, 3, 9)), F.lit(True)).collect() == []
    two = metric_tree.top_products(table_of(spark, random_rows(2, 3, 9)), F.lit(True)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in two) == [(0, 1, 1), (1, 1, 0)]


# --- whitening -----------------------------------------------------------------------------

def brute_whitened(rows, scale, offset):
    x = np.array([[int(np.floor(scale * c)) + offset for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    centred = ((n * x - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    deviation = ((n * x - sums) ** 2).sum(1)
    return centred, values[::-1], axes[:, ::-1], deviation


def check_whitened(found, rows, scale, offset, count, rank):
    centred, values, axes, deviation = brute_whitened(rows, scale, offset)
    count = min(count, rank)
    assert len(found) == len(rows) * count and {r.n for r in found} == {len(rows)}
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    got = np.array([[by_id[i][c + 1].whitened for c in range(count)] for i, _ in rows])
    want = centred @ axes[:, :count] / np.sqrt(values[:count])
    signs = np.sign((got * want).sum(0))
    assert np.abs(got * signs - want).max() < 1e-7
    assert [int(by_id[i][1].deviation) for i, _ in rows] == deviation.tolist()
    explained = np.array([by_id[rows[0][0]][c + 1].explained for c in range(count)])
    assert np.abs(explained / (values[:count] / values.sum()) - 1).max() < 1e-9
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-8


@pytest.mark.parametrize("name,rows,rank", [
    ("full", [(i, (np.array(v) * np.arange(1, 8)).tolist()) for i, v in random_rows(80, 7, 1)], 7),
    ("few rows", random_rows(5, 7, 2), 4),
    ("low rank", [(i, [*v, v[0], 3 * v[1], 0.5]) for i, v in enumerate(np.random.default_rng(3).integers(-9, 9, (60, 4)).astype(float).tolist())], 4),
    ("wide range", [(i, (np.array(v) * [1e6, 1.0, 1e-1]).tolist()) for i, v in random_rows(70, 3, 4)], 3),
])
def test_whitened_against_eigenvectors(spark, monkeypatch, name, rows, rank):
    monkeypatch.setattr(lanczos_whitening, "HELD", 7)
    frame = table_of(spark, rows + odd_rows(7) + [(9006, []), (9007, [1.0] * 19)])
    found = lanczos_whitening.whiten(frame, count=6, scale=64, offset=1000).collect()
    check_whitened(found, rows, 64, 1000, 6, rank)


def test_equal_eigenvalues_lose_no_component(spark):
    """A box of corners has one eigenvalue only: the Krylov space closes at once and is started anew."""
    rows = [(i, [float(1 if i >> b & 1 else -1) for b in range(4)]) for i in range(16)]
    found = lanczos_whitening.whiten(table_of(spark, rows), scale=1, offset=0).collect()
    assert len(found) == 64 and found[0].identity_error < 1e-12 and all(abs(r.explained - 0.25) < 1e-12 for r in found)


def test_whitening_of_few_rows(spark):
    assert lanczos_whitening.whiten(table_of(spark, [])).collect() == []
    assert lanczos_whitening.whiten(table_of(spark, odd_rows(3) + [(1, [])])).collect() == []
    assert lanczos_whitening.whiten(table_of(spark, [(i, [1.0, 2.0]) for i in range(9)])).collect() == []
    rows = [(None, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])]
    found = lanczos_whitening.whiten(table_of(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.component, round(abs(r.whitened), 9)) for r in found) == [
        ("1", 1, round(0.5**0.5, 9)), ("1", 1, round(0.5**0.5, 9)), ("None", 1, round(2**0.5, 9))]


def test_exact_deviations_beyond_a_long():
    x = np.array([[2**40, 0], [-2**40, 5], [7, 7]], np.int64)
    sums = [int(s) for s in x.sum(0)]
    centre = lanczos_whitening.Centre(2**30, sums)
    assert centre.deviations(x) == [sum((2**30 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]


# --- registered queries --------------------------------------------------------------------

@pytest.mark.parametrize("name", ["op11_subvector_clusters", "op12_metric_tree"])
def test_query_equals_statement(spark, name):
    assert compare(queries.QUERIES[name](spark, SF_DIR), tables(SF_DIR), queries.SQL[name]) > 0


def test_whitening_query(spark):
    frame = queries.table(spark, SF_DIR, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    found = queries.op13_lanczos_whitening(spark, SF_DIR)
    assert dict(found.dtypes)["deviation"] == "bigint"
    check_whitened(found.collect(), rows, 64, 1_000_000, 32, 64)
