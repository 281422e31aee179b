"""Quality of texts: a generalised additive model with pairwise interactions.

Each feature of a text is binned at quantiles of the sample. Boosting goes round the features; each
turn fits a shallow tree over one feature's bins to the residual and adds its leaves, times a small
rate, to that feature's lookup table. Then the pairs whose coarse grids still explain most of the
residual get tables of their own, boosted in the same way. A score is the sum of table entries at
the text's bins: one gather for each table over all texts of a batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches, texts

BINS, PAIR_BINS, PAIRS = 32, 8, 8
#: Sample bound of training: labelled rows, those of least hash.
SAMPLE_ROWS = 20_000

FEATURES = (
    "chars", "words", "mean_word", "long_words", "upper", "digits", "symbols", "spaces", "distinct_words",
    "top_word", "repeats", "symbol_ends", "plain_words", "lines", "words_per_line", "distinct_lines",
    "sentences", "halves", "top_pair", "non_ascii",
)
_DROP = {
    "upper": bytes(range(65, 91)), "digits": b"0123456789", "spaces": b" \t\n\r\x0b\x0c",
    "symbols": bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"?!()-"),
}


def features(text: str) -> list[float]:
    """The numbers behind a score, in the order of ``FEATURES``; all are 0 for a blank text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)

    def part(kind: str) -> float:
        return (size - len(raw.translate(None, _DROP[kind]))) / size

    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    pairs = Counter(zip(words, words[1:]))
    half = n // 2
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(lengths.mean()), float((lengths > 15).mean()),
        part("upper"), part("digits"), part("symbols"), part("spaces"), len(counts) / n,
        max(counts.values()) / n, repeats / n,
        sum(w[-1] in b"#$%&*@!^~|<>=+\\/" for w in words) / n, sum(map(bytes.isalpha, words)) / n,
        float(np.log1p(len(lines))), n / len(lines), len(set(lines)) / len(lines),
        raw.count(b". ") / n, len(set(words[:half]) & set(words[half:])) / len(counts),
        max(pairs.values(), default=0) / n, sum(map(bytes.isascii, words)) / n,
    ]


def _feature_rows(extra: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = pa.array([features(t) for t in texts(batch)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in extra] + [found], [*extra, "features"])
    return work


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[at[:, j]]
        for j, k, table in self.pairs:
            total += table[coarse(at[:, j], len(self.tables[j])), coarse(at[:, k], len(self.tables[k]))]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def coarse(bins: np.ndarray, count: int) -> np.ndarray:
    return bins * min(PAIR_BINS, count) // max(1, count)


def _tree(slope: np.ndarray, weight: np.ndarray, depth: int, least: float = 1.0) -> np.ndarray:
    """Leaf values over a run of bins, split at the best places, ``depth`` times at most."""
    g, h = slope.sum(), weight.sum()
    if depth and len(slope) > 1:
        gl, hl = np.cumsum(slope)[:-1], np.cumsum(weight)[:-1]
        gain = gl**2 / (hl + least) + (g - gl) ** 2 / (h - hl + least) - g**2 / (h + least)
        at = int(gain.argmax()) + 1
        if gain[at - 1] > 1e-9:
            return np.r_[_tree(slope[:at], weight[:at], depth - 1), _tree(slope[at:], weight[at:], depth - 1)]
    return np.full(len(slope), g / (h + least))


def _grid_tree(slope: np.ndarray, weight: np.ndarray, depth: int, least: float = 1.0) -> np.ndarray:
    """The same over a grid: each split cuts along the better axis."""
    g, h = slope.sum(), weight.sum()
    best = (1e-9, None, None)
    if depth:
        for axis in (0, 1):
            gl, hl = np.cumsum(slope.sum(1 - axis))[:-1], np.cumsum(weight.sum(1 - axis))[:-1]
            if len(gl):
                gain = gl**2 / (hl + least) + (g - gl) ** 2 / (h - hl + least) - g**2 / (h + least)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], axis, at + 1)
    if best[1] is None:
        return np.full(slope.shape, g / (h + least))
    parts = [_grid_tree(s, w, depth - 1) for s, w in zip(
        np.split(slope, [best[2]], best[1]), np.split(weight, [best[2]], best[1]))]
    return np.concatenate(parts, best[1])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1) -> Model:
    """Boosts log-odds of y = 1; with one class only, the score is its smoothed share."""
    x, y = np.asarray(x, float).reshape(-1, len(FEATURES)), np.asarray(y, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(intercept, edges, tables, [])
    if len(set(y.tolist())) < 2:
        return model
    at = model.bins(x)
    total = np.full(len(y), intercept)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(tables):
            slope, weight = residual()
            step = rate * _tree(np.bincount(at[:, j], slope, len(table)), np.bincount(at[:, j], weight, len(table)), 2)
            table += step
            total += step[at[:, j]]
    slope, weight = residual()
    rough = [coarse(at[:, j], len(tables[j])) for j in range(len(FEATURES))]
    width = [min(PAIR_BINS, len(t)) for t in tables]

    def grid(j, k, values):
        return np.bincount(rough[j] * width[k] + rough[k], values, width[j] * width[k]).reshape(width[j], width[k])

    gains = []
    for j in range(len(FEATURES)):
        for k in range(j + 1, len(FEATURES)):
            g, h = grid(j, k, slope), grid(j, k, weight)
            gains.append((float((g**2 / (h + 1)).sum()), j, k))
    chosen = [(j, k, np.zeros((width[j], width[k]))) for _, j, k in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(pair_rounds):
        for j, k, table in chosen:
            slope, weight = residual()
            step = rate * _grid_tree(grid(j, k, slope), grid(j, k, weight), 3)
            table += step
            total += step[rough[j], rough[k]]
    model.pairs = chosen
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents.

    ``labels``: (doc_id, quality 0 or 1); other values and null ids are no labels, and an id with both
    labels counts as 1. The ids of least hash are chosen before the texts are read; ids that are not in
    ``docs`` are never chosen.
    """
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    given = given.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    given = given.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.join(F.broadcast(chosen), "doc_id").select("text", "quality").mapInArrow(
        _feature_rows(["quality"]), "quality int, features array<double>")
    found = found.orderBy(F.xxhash64("features")).limit(2 * rows).collect()
    return np.array([r[1] for r in found], float).reshape(-1, len(FEATURES)), np.array([r[0] for r in found], float)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs`` (doc_id, text), from the whole text alone.

    score is the probability of label 1; a null text counts as empty and an empty one has features 0.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            p = model.scores(np.array([features(t) for t in texts(batch)]).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores ``least`` or more."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            p = model.scores(np.array([features(t) for t in texts(batch)]).reshape(-1, len(FEATURES)))
            yield batch.filter(pa.array(p >= least))

    return docs.mapInArrow(work, docs.schema)
