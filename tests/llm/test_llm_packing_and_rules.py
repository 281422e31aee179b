"""Packing, url rules and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing, permutation_index, url_rules


def brute_pack(pieces, capacity):
    bins, out = [], {}
    for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][0]):
        size, source, group = pieces[i]
        best = None
        for k, (room, sources, groups) in enumerate(bins):
            if room >= size and (source is None or source not in sources) and (group is None or group not in groups):
                if best is None or room < bins[best][0]:
                    best = k
        if best is None:
            bins.append([capacity, set(), set()])
            best = len(bins) - 1
        room = bins[best][0]
        out[i] = (best, capacity - room)
        bins[best][0] -= size
        bins[best][1].add(source)
        bins[best][2].add(group)
    return [out[i] for i in range(len(pieces))]


@pytest.mark.parametrize("seed", range(6))
def test_tightest_compatible_bin(seed):
    pick = random.Random(seed)
    pieces = [(pick.choice([0, 5, 20, 33, 50, 100, pick.randint(1, 100)]), pick.choice(["hot", "hot", None, *"abcdefg"]), pick.choice([None, *range(40)])) for _ in range(300)]
    assert packing.pack(pieces, 100) == brute_pack(pieces, 100)


def test_packing_keeps_every_piece_and_conflict(spark):
    pick = random.Random(9)
    rows = [(i if i % 11 else None, "w" * pick.randint(0, 300) if i % 13 else None, pick.choice(["hot", "a", "b", None]), f"{i}") for i in range(400)] + [(1001, "abc", "a", "1")] * 3 + [(1002, "é" * 5000, "b", "2")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, bin string")
    found = packing.best_fit(frame, capacity=400, pieces=100).collect()
    sizes = [len(r[1] or "") for r in rows]
    assert sum(r["size"] for r in found) == sum(sizes) and len(found) == sum(max(1, -(-s // 400)) for s in sizes)
    by_bin = {}
    for r in found:
        by_bin.setdefault(r.bin, []).append(r)
    for members in by_bin.values():
        members.sort(key=lambda r: (r.start, r["size"]))
        assert sum(r["size"] for r in members) <= 400
        assert all(a.start + a["size"] == b.start for a, b in zip(members, members[1:]))
    source = {(r[0]): r[2] for r in rows if r[0] is not None}
    for members in by_bin.values():
        own = [source[r.doc_id] for r in members if r.doc_id is not None and source[r.doc_id]]
        assert len(own) == len(set(own))
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def brute_judge(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not host or not fits:
        return host, path, None, "allow"
    best = max(fits)
    return host, path, best[2], best[3]


def test_rules_equal_brute_force(spark):
    pick = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "x.b.a.com", "ab.com", "org", "a.org", "ümlaut.org"]
    paths = ["", "/", "/en", "/en/", "/en/a", "/enx", "/é/", "/en/a/b"]
    rules = sorted({(pick.choice(hosts), pick.choice(paths)) for _ in range(25)})
    rules = [(h, p, pick.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http{pick.choice(['', 's'])}://{pick.choice(['', 'WWW.', 'x.'])}{pick.choice(hosts)}{pick.choice(paths)}{pick.choice(['', 'more', '?q=/en/', '#x'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "http://", "://", "http:///path", "http://a.com" + "/en/" * 3000, "http://" + "a." * 2000 + "com/en/", "http://com.", "x://y://a.com/"] + ["http://a.com/en/"] * 50
    given = spark.createDataFrame(rules + [(None, "/", "block"), ("com", None, "block"), ("com", "/", None)], "host string, path string, verdict string")
    frame = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for tasks in (1, 7):
        found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(frame, given, tasks=tasks).collect()}
        assert len(found) == len(urls)
        for i, url in enumerate(urls):
            assert found[i] == brute_judge(url, rules), url


def test_rules_of_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in url_rules.judge(pages, none).select("rule", "verdict").collect()] == [(None, "allow")]
    assert url_rules.judge(pages.limit(0), none).collect() == []
    twice = spark.createDataFrame([("a.com", "/", "allow"), ("A.com", "/", "block")], "host string, path string, verdict string")
    assert url_rules.judge(pages, twice, default="block").first().verdict == "block"


def test_native_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/", "block")], "host string, path string, verdict string")
    plan = url_rules.judge(pages, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute_search(rows, count):
    good = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 4:
            good.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = set()
    for q in good:
        if q % 3 == 0:
            own = min(map(tuple, good[q]))
            found = sorted(((-float(np.dot(own, v)), i) for i in good for v in good[i] if i != q))[:count]
            out |= {(q, k + 1, i, round(-s, 9)) for k, (s, i) in enumerate(found)}
    return out


def test_search_small_tables_exactly(spark):
    pick = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in pick.normal(size=4) * pick.choice([1, 5])], 0) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1], 0) for i in range(30)]  # ties
    rows += [(200, None, 0), (201, [0.0] * 4, 0), (202, [1.0, None, 0.0, 0.0], 0), (203, [float("nan"), 1.0, 1.0, 1.0], 0), (204, [float("inf"), 1.0, 1.0, 1.0], 0),
             (205, [1.0] * 3, 0), (206, [], 0), (None, [1.0] * 4, 0), (3, [9.0, 9.0, 9.0, 9.0], 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = permutation_index.search(frame, F.col("vec_id") % 3 == 0, count=7)
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in found.collect()} == brute_search(rows, 7)
    assert permutation_index.search(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []
    two = permutation_index.search(spark.createDataFrame(rows[:2], SCHEMA), F.lit(True)).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(two)] == [(0, 1, 1), (1, 1, 0)]


def test_search_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "BLOCK", 700)
    monkeypatch.setattr(permutation_index, "QUERY_BLOCK", 30)
    pick = np.random.default_rng(2)
    x = pick.normal(size=(3000, 24)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    found = permutation_index.search(frame, F.col("vec_id") % 50 == 0, count=10, pivots=128).collect()
    exact, hits = x.astype(float) @ x.astype(float).T, 0
    for q in range(0, 3000, 50):
        exact[q, q] = -np.inf
        hits += len(set(np.argsort(-exact[q])[:10]) & {r.vec_id for r in found if r.query_id == q})
    assert len(found) == 600 and hits / 600 >= 0.9


def test_search_recall_with_production_settings(spark):
    """One block full and one in part, of vectors spread evenly and with a crowded place of copies."""
    pick = np.random.default_rng(4)
    x = pick.normal(size=(permutation_index.BLOCK + 4000, 64)).astype(np.float32)
    x[::3] = x[0] + pick.normal(size=x[::3].shape).astype(np.float32) * 0.05
    x[::9] = x[1]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    found = permutation_index.search(frame, F.col("vec_id") % 100 == 0).collect()
    queries = range(0, len(x), 100)
    mine = {q: {} for q in queries}
    for r in found:
        mine[r.query_id][r.vec_id] = r.score
    hits = 0
    for q in queries:
        scores = (x.astype(float) * x[q].astype(float)).sum(1)
        scores[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), -scores))[:20].tolist()) & set(mine[q]))
        assert all(scores[i] == s for i, s in mine[q].items())
    assert len(found) == 20 * len(queries) and hits / len(found) >= 0.9


def test_nearest_pivots_in_order():
    pick = np.random.default_rng(6)
    for likeness in (pick.normal(size=(50, 200)), pick.integers(0, 5, (50, 200)).astype(float), pick.normal(size=(3, 10))):
        width = min(permutation_index.NEAREST, likeness.shape[1])
        assert (permutation_index.nearest(likeness) == np.argsort(-likeness, axis=1, kind="stable")[:, :width]).all()


def test_urls_of_one_key_are_dealt_over_ranges(spark, monkeypatch):
    """All hosts below one suffix have one probe there for each path."""
    taken = []
    real = url_rules.written
    monkeypatch.setattr(url_rules, "written", lambda df: taken.append(real(df)) or taken[-1])
    pages = spark.createDataFrame([(i, f"http://h{i}.com/") for i in range(3000)] + [(i, f"http://h{i}.org/x{i}") for i in range(3000, 4000)], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block"), ("h7.com", "/", "allow"), ("org", "/x", "block")], "host string, path string, verdict string")
    found = url_rules.judge(pages, rules, tasks=8).collect()
    assert sum(r.verdict == "block" for r in found) == 3999 and {r.rule for r in found if r.page_id == 7} == {"h7.com/"}
    sizes = [r["count"] for r in taken[0].groupBy("range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2.5 * sum(sizes) / 8


def test_repeated_rows_are_dealt_over_shards(spark):
    frame = spark.createDataFrame([(None, None, None)] * 800 + [(5, "same words", "a")] * 400, "doc_id long, text string, source string")
    found = packing.best_fit(frame, pieces=100).collect()
    sizes = {}
    for r in found:
        sizes[r.bin >> 32] = sizes.get(r.bin >> 32, 0) + 1
    assert len(found) == 1200 and len(sizes) == 12 and max(sizes.values()) < 180
