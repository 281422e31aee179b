"""Language ID and quality: exact forward-backward, held-out accuracy, defined results at the edges."""

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import langid, quality

WORDS = {"aa": "the and of with this that".split(), "bb": "der die und nicht mit eine".split(), "cc": "que los para una como el".split()}
EDGES = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "123 ### !!", "x"), (None, "the and of", "x"), (5, "the of", "x"), (5, "the of", "x"), (6, "die und " * 40_000, "x")]
EDGE_SCHEMA = "doc_id long, text string, score string"  # a column named like a result


def texts_of(label: str, n: int, seed: int) -> list[str]:
    pick = random.Random(f"{label}{seed}")
    return [" ".join(pick.choice(WORDS[label]) + pick.choice(["", "s", "n"]) for _ in range(pick.randint(5, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return langid.fit([(t, label) for label in WORDS for t in texts_of(label, 60, 1)])


@pytest.mark.parametrize("lengths", [[1, 4, 0, 3], [4], [0, 0], [2, 2, 2]])
def test_forward_backward_equals_enumeration(lengths):
    random_ = np.random.default_rng(len(lengths))
    k, n = 3, sum(lengths)
    score, move = random_.normal(size=(n, k)), random_.normal(size=(k, k))
    marginal, pairs, log_sum = langid.forward_backward(score, np.array(lengths), move)
    want, want_pairs, total, at = np.zeros((n, k)), np.zeros((k, k)), 0.0, 0
    for size in filter(None, lengths):
        s, z, one, two = score[at:at + size], 0.0, np.zeros((size, k)), np.zeros((k, k))
        for y in itertools.product(range(k), repeat=size):
            w = np.exp(sum(s[i, y[i]] for i in range(size)) + sum(move[y[i - 1], y[i]] for i in range(1, size)))
            z += w
            for i in range(size):
                one[i, y[i]] += w
            for i in range(1, size):
                two[y[i - 1], y[i]] += w
        want[at:at + size], want_pairs, total, at = one / z, want_pairs + two / z, total + np.log(z), at + size
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and np.isclose(log_sum, total)


def test_lanes_join_exactly():
    random_ = np.random.default_rng(3)
    score, move = random_.normal(size=(1000, 3)), random_.normal(size=(3, 3))
    whole = langid.forward_backward(score, np.array([700, 300]), move)
    lane, langid.LANE = langid.LANE, 2000
    try:
        uncut = langid.forward_backward(score, np.array([700, 300]), move)
    finally:
        langid.LANE = lane
    assert np.allclose(whole[0], uncut[0]) and np.allclose(whole[1], uncut[1]) and np.isclose(whole[2], uncut[2])


def test_held_out_texts_and_switched_words(model):
    for label in WORDS:
        found, share = model.label_texts(texts_of(label, 40, 2))
        assert found == [label] * 40 and min(share) > 0.5
    switched = model.label_words("the and of with this der die und nicht mit los para una como el")
    assert [s[1] for s in switched] == ["aa"] * 5 + ["bb"] * 5 + ["cc"] * 5


def test_predict_edges(spark, model):
    rows = langid.predict(spark.createDataFrame(EDGES, EDGE_SCHEMA), model).collect()
    found = sorted([tuple(r) for r in rows], key=str)
    assert len(found) == len(EDGES)
    by_id = {r[0]: r for r in found}
    assert all(by_id[i][1:] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert by_id[None][1] == "aa" and by_id[5][1] == "aa" and by_id[6][1] == "bb"
    assert sum(r[0] == 5 for r in found) == 2
    assert all(0 <= r[2] <= 1 for r in found)
    empty = spark.createDataFrame([], EDGE_SCHEMA)
    assert langid.predict(empty, model).collect() == []
    assert {r.doc_id for r in langid.keep(spark.createDataFrame(EDGES, EDGE_SCHEMA), model, 0.5).collect()} == {None, 5, 6}


def test_sample_is_bounded_and_learns_nothing_from_nothing(spark):
    rows = [(i, t, label) for label in WORDS for i, t in enumerate(texts_of(label, 30, 4))] + [(9, "x y", None), (9, None, "aa"), (9, " ", "aa")]
    sample = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_label=7, words=10)
    assert [sum(lang == label for _, lang in sample) for label in WORDS] == [7, 7, 7]
    assert max(len(t.split()) for t, _ in sample) <= 10
    none = langid.fit(langid.sample(spark.createDataFrame([], "doc_id long, text string, lang string")))
    assert none.labels == []
    found = langid.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), none).collect()
    assert [tuple(r) for r in found] == [(1, "und", 0.0)]
    only = langid.fit([("abc def", "aa")])
    assert only.label_texts(["abc", "1"])[0] == ["aa", "und"]


def quality_rows(n: int, seed: int):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        words = [pick.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + pick.choice("abcdefg") for _ in range(pick.randint(20, 120))]
        good = i % 3 > 0
        rows.append((i, " ".join(words if good else [w + pick.choice(["###", "$$$", "%%%"]) for w in words]), int(good)))
    return rows


def test_quality_held_out(spark):
    rows = quality_rows(300, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2] + [(1, 0), (None, 1), (7, 5)], "doc_id long, quality int")
    x, y = quality.sample(docs, labels, rows=100)
    assert len(x) == len(y) == 100
    model = quality.fit(x, y)
    found = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(found[i].predicted == q for i, _, q in rows if i % 2 == 0)
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in found.values())


def test_quality_edges(spark):
    model = quality.fit(*[np.array(c) for c in zip(*[(quality.features(t), q) for _, t, q in quality_rows(60, 2)])])
    found = quality.score(spark.createDataFrame(EDGES, EDGE_SCHEMA), model).collect()
    assert len(found) == len(EDGES) and all(0 <= r.score <= 1 for r in found)
    blank = {r.score for r in found if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1  # null, empty and blank texts score alike
    assert quality.score(spark.createDataFrame([], EDGE_SCHEMA), model).collect() == []
    kept = quality.keep(spark.createDataFrame(EDGES, EDGE_SCHEMA), model, 0.0)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == len(EDGES)


def test_quality_without_labels_or_with_one_class(spark):
    empty_docs, empty_labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(*quality.sample(empty_docs, empty_labels))
    assert np.allclose(model.scores(np.array([quality.features("a b")])), 0.5)
    ones = quality.fit(np.array([quality.features("a b")] * 4), np.ones(4))
    assert ones.scores(np.array([quality.features("c")]))[0] > 0.5


def test_pairs_explain_what_single_features_cannot():
    random_ = np.random.default_rng(5)
    x = np.zeros((2000, len(quality.FEATURES)))
    x[:, :2] = random_.random((2000, 2))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=20, pair_rounds=60)
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.85


def plain_tree(cells, depth):
    """Value by cell of a tree over ``cells`` {place tuple: (slope, weight)}: the best cut of all, by trying each."""
    def total(part):
        return sum(g for g, _ in part.values()), sum(h for _, h in part.values())

    g, h = total(cells)
    best = (1e-9, None)
    if depth:
        for axis in range(len(next(iter(cells)))):
            for cut in sorted({place[axis] for place in cells})[1:]:
                left = {p: c for p, c in cells.items() if p[axis] < cut}
                (gl, hl), gain = total(left), 0
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, axis, cut)
    if best[1] is None:
        return {p: g / (h + 1) for p in cells}
    _, axis, cut = best
    return {k: v for side in (0, 1) for k, v in plain_tree({p: c for p, c in cells.items() if (p[axis] >= cut) == side}, depth - 1).items()}


def plain_scores(x, y, rounds, pair_rounds, rate=0.1):
    """The same model one row and one bin at a time: scores of the rows it is fitted on."""
    rows, width = range(len(x)), len(x[0])
    share = (sum(y) + 0.5) / (len(y) + 1)
    edges = [sorted(set(np.quantile([r[j] for r in x], np.arange(1, quality.BINS) / quality.BINS).tolist())) for j in range(width)]
    at = [[sum(e <= r[j] for e in edges[j]) for j in range(width)] for r in x]
    total = [float(np.log(share / (1 - share)))] * len(x)

    def fitted(place, shape, depth):
        p = [1 / (1 + np.exp(-t)) for t in total]
        cells = {c: [0.0, 0.0] for c in itertools.product(*map(range, shape))}
        for i in rows:
            cells[place(i)][0] += y[i] - p[i]
            cells[place(i)][1] += p[i] * (1 - p[i])
        return cells, lambda: plain_tree({k: tuple(v) for k, v in cells.items()}, depth)

    def step(place, shape, depth):
        values = fitted(place, shape, depth)[1]()
        for i in rows:
            total[i] += rate * values[place(i)]

    for _ in range(rounds):
        for j in range(width):
            step(lambda i: (at[i][j],), (len(edges[j]) + 1,), 2)
    bins = [min(quality.PAIR_BINS, len(e) + 1) for e in edges]
    rough = [[at[i][j] * bins[j] // (len(edges[j]) + 1) for j in range(width)] for i in rows]
    gains = []
    for j, k in itertools.combinations(range(width), 2):
        cells, _ = fitted(lambda i: (rough[i][j], rough[i][k]), (bins[j], bins[k]), 0)
        gains.append((sum(g * g / (h + 1) for g, h in cells.values()), j, k))
    for _ in range(pair_rounds):
        for _, j, k in sorted(gains, reverse=True)[:quality.PAIRS]:
            step(lambda i: (rough[i][j], rough[i][k]), (bins[j], bins[k]), 3)
    return [1 / (1 + np.exp(-t)) for t in total]


def test_boosting_against_a_plain_version():
    pick = np.random.default_rng(11)
    x = np.zeros((70, len(quality.FEATURES)))
    x[:, :4] = pick.normal(size=(70, 4)).round(1)
    y = ((x[:, 0] * x[:, 1] + x[:, 2] + pick.normal(size=70) * 0.2) > 0).astype(float)
    model = quality.fit(x, y, rounds=2, pair_rounds=2)
    assert np.allclose(model.scores(x), plain_scores(x.tolist(), y.tolist(), 2, 2), atol=1e-9)
    assert len(set(np.round(model.scores(x), 9))) > 20
