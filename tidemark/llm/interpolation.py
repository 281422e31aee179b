"""Log-probabilities of texts under a bigram model with deleted interpolation.

The probability of a word is a mixture of its maximum-likelihood estimates after its context, alone,
and uniformly. The weights depend on how often the context occurs (buckets by powers of two) and are
learned by expectation-maximisation on a part of the training texts that is left out of the counts.

Counts never meet in one place. Texts are cut into chunks of words, written once as numbers. A chunk
sends its distinct grams, each once, to buckets of the hash range; a bucket adds up the counts of all
chunks and answers each chunk in the order it asked. Chunk and answers then meet to score its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Places, chunk_numbers, partitions, text_batches, texts, written
from tidemark.llm.packed import least_type, pack, unpack

#: Words of a chunk, and grams of a bucket of the hash range.
CHUNK, BUCKET = 1_500_000, 2_000_000
#: One in so many training texts is left out of the counts that weights are learned on.
DELETED = 8
#: Steps of log2 in which probabilities of left-out words are counted.
STEPS = 8
END, START = 0, 1
CONTEXTS = 64

_CHUNK = ("chunk long, deleted boolean, train_tokens long, deleted_tokens long, train_docs long, deleted_docs long, "
          "bigrams long, doc_id array<long>, body array<binary>")
_ASK = "level int, bucket int, chunk long, grams binary, train binary, left_out binary"
_ANSWER = "level int, bucket int, chunk long, counts binary, left_out binary, types long, main_types long"
_SCORE = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _words(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased, between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _bigram_keys(vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of (word before, word) at each place; before a text's first word is START."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = START
    mixed = vocabulary[before] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed = (mixed + vocabulary[tokens]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed * np.uint64(0x94D049BB133111EB)


class _Chunk:
    """Texts being gathered: 0 is the end of a text, 1 its start, other words as they come."""

    def __init__(self):
        self.places = Places({b"\n": END, b"\t": START})  # no word holds white space
        self.ids, self.roles, self.tokens, self.size = [], [], [], 0

    def add(self, doc_id, role: int, text: str) -> None:
        tokens = np.array([*map(self.places.__getitem__, _words(text)), END], np.uint32)
        self.ids.append(doc_id)
        self.roles.append(role)
        self.tokens.append(tokens)
        self.size += len(tokens)

    def row(self, name: int, deleted: bool) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, self.tokens), np.uint32, len(self.tokens))
        tokens = np.concatenate(self.tokens)
        roles = np.array(self.roles, np.uint8)
        vocabulary = np.array([xxhash.xxh64_intdigest(w) for w in self.places], np.uint64)
        train, out = int(lengths[roles > 0].sum()), int(lengths[roles == 2].sum())
        bigrams = len(np.unique(_bigram_keys(vocabulary, tokens, lengths)))
        body = [pack(roles), pack(lengths), pack(vocabulary), pack(least_type(tokens))]
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64()), pa.array([deleted]), pa.array([train], pa.int64()), pa.array([out], pa.int64()),
             pa.array([int((roles > 0).sum())], pa.int64()), pa.array([int((roles == 2).sum())], pa.int64()), pa.array([bigrams], pa.int64()),
             pa.array([self.ids], pa.list_(pa.int64())), pa.array([body], pa.list_(pa.binary()))],
            ["chunk", "deleted", "train_tokens", "deleted_tokens", "train_docs", "deleted_docs", "bigrams", "doc_id", "body"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Left-out texts go to chunks of their own."""
    open_, names = {False: _Chunk(), True: _Chunk()}, chunk_numbers()
    for batch in text_batches(batches):
        for doc_id, role, text in zip(batch.column("doc_id").to_pylist(), batch.column("role").to_pylist(), texts(batch)):
            deleted = role == 2
            open_[deleted].add(doc_id, role, text)
            if open_[deleted].size >= CHUNK:
                yield open_[deleted].row(next(names), deleted)
                open_[deleted] = _Chunk()
    for deleted, chunk in open_.items():
        if chunk.size:
            yield chunk.row(next(names), deleted)


def _grams(body: list[bytes], level: int):
    """(sorted distinct gram hashes, gram of each place, roles, lengths, tokens, vocabulary)."""
    roles, lengths, vocabulary, tokens = map(unpack, body)
    lengths, tokens = lengths.astype(np.int64), tokens.astype(np.int64)
    keys = vocabulary[tokens] if level == 1 else _bigram_keys(vocabulary, tokens, lengths)
    grams, place = np.unique(keys, return_inverse=True)
    return grams, place, roles, lengths, tokens, vocabulary


def _bounds(grams: np.ndarray, buckets: int) -> np.ndarray:
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(grams, edges), len(grams)]


def _ask(buckets: dict[int, int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist()):
                for level, count in buckets.items():
                    grams, place, roles, lengths, *_ = _grams(body, level)
                    role = np.repeat(roles, lengths)
                    train = np.bincount(place[role > 0], minlength=len(grams))
                    out = np.bincount(place[role == 2], minlength=len(grams))
                    cuts = _bounds(grams, count)
                    rows = [(level, b, chunk, pack(grams[lo:hi], True), pack(least_type(train[lo:hi])), pack(least_type(out[lo:hi])))
                            for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3))],
                        ["level", "bucket", "chunk", "grams", "train", "left_out"])
    return work


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """Counts over all chunks of the grams of one bucket, for each chunk in its order."""
    grams = [unpack(g) for g in asked.column("grams").to_pylist()]
    found, place = np.unique(np.concatenate(grams), return_inverse=True)
    totals = [np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)]
    at = 0
    for mine, *counts in zip(grams, asked.column("train").to_pylist(), asked.column("left_out").to_pylist()):
        here = place[at:at + len(mine)]
        for total, packed in zip(totals, counts):
            total[here] += unpack(packed).astype(np.int64)
        at += len(mine)
    rows, at = [], 0
    for chunk, mine in zip(asked.column("chunk").to_pylist(), grams):
        here = place[at:at + len(mine)]
        rows.append((chunk, *(pack(least_type(total[here])) for total in totals)))
        at += len(mine)
    level, bucket = (k.as_py() for k in key)
    n = len(rows)
    types, main = int((totals[0] > 0).sum()), int((totals[0] > totals[1]).sum())
    return pa.table({
        "level": pa.array([level] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "chunk": [r[0] for r in rows],
        "counts": pa.array([r[1] for r in rows], pa.binary()), "left_out": pa.array([r[2] for r in rows], pa.binary()),
        "types": pa.array([types] + [0] * (n - 1), pa.int64()), "main_types": pa.array([main] + [0] * (n - 1), pa.int64())})


def _met(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk's row, then its answers by level and bucket, in one task."""
    nothing = F.lit(None)
    body = chunks.select("chunk", F.lit(0).alias("level"), F.lit(0).alias("bucket"), "doc_id", "body", nothing.cast("binary").alias("counts"), nothing.cast("binary").alias("left_out"))
    parts = answers.join(chunks.select("chunk"), "chunk", "left_semi").select(
        "chunk", "level", "bucket", nothing.cast("array<long>").alias("doc_id"), nothing.cast("array<binary>").alias("body"), "counts", "left_out")
    both = body.union(parts).repartition(partitions(chunks.sparkSession), "chunk")
    return both.sortWithinPartitions("chunk", "level", "bucket")


def _with_counts(batches: Iterator[pa.RecordBatch]):
    """(ids, body, counts by level, left-out counts by level) of each chunk."""
    ids = body = chunk = None
    counts, out = {1: [], 2: []}, {1: [], 2: []}
    for batch in batches:
        for row in batch.to_pylist():
            if row["level"] == 0:
                if chunk is not None:
                    yield ids, body, counts, out
                ids, body, chunk = row["doc_id"], row["body"], row["chunk"]
                counts, out = {1: [], 2: []}, {1: [], 2: []}
            elif row["chunk"] != chunk:
                raise ValueError(f"answers without chunk {row['chunk']}")
            else:
                counts[row["level"]].append(unpack(row["counts"]).astype(np.int64))
                out[row["level"]].append(unpack(row["left_out"]).astype(np.int64))
    if chunk is not None:
        yield ids, body, counts, out


def _places(body, counts, out, main_only: bool, docs: int):
    """Per place: count of the word, of the bigram and of the context; and the texts' lengths and tokens."""
    _, place1, _, lengths, tokens, vocabulary = _grams(body, 1)
    _, place2, *_ = _grams(body, 2)
    c1, c2 = (np.concatenate(counts[k]) - (np.concatenate(out[k]) if main_only else 0) for k in (1, 2))
    word, pair = c1[place1], c2[place2]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(lengths) - lengths] = docs
    return word, pair, context, lengths, tokens


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one bucket for each doubling."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _left_out_grid(main_tokens: int, main_docs: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, body, counts, out in _with_counts(batches):
            word, pair, context, *_ = _places(body, counts, out, True, main_docs)
            with np.errstate(divide="ignore", invalid="ignore"):
                two = np.where(pair > 0, np.round(-STEPS * np.log2(pair / np.maximum(context, 1))), -1).astype(np.int64)
                one = np.where(word > 0, np.round(-STEPS * np.log2(word / max(main_tokens, 1))), -1).astype(np.int64)
            cells, n = np.unique(np.stack([_bucket(context), two, one]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cells, n)], ["bucket", "two", "one", "n"])
    return work


def weights(grid: np.ndarray, vocabulary: int, rounds: int = 100) -> np.ndarray:
    """(context bucket, 3) mixture weights of bigram, word and uniform estimate, by expectation-maximisation.

    ``grid``: rows (bucket, bigram step, word step, count) of left-out words; a step of -1 is probability
    0, others powers of two in ``STEPS`` to the halving. Buckets without left-out words take the nearest
    lower bucket's weights that has some, else equal ones. Unseen contexts put no weight on bigrams.
    """
    found = np.full((CONTEXTS, 3), 1 / 3)
    found[0] = [0, 0.5, 0.5]
    last = found[1]
    for b in range(CONTEXTS):
        rows = grid[grid[:, 0] == b]
        if not len(rows):
            if b:
                found[b] = last
            continue
        p = np.stack([np.where(rows[:, k] >= 0, 2.0 ** (-rows[:, k] / STEPS), 0.0) for k in (1, 2)] + [np.full(len(rows), 1 / (vocabulary + 1))], 1)
        share = found[b].copy()
        for _ in range(rounds):
            part = p * share
            part *= (rows[:, 3] / part.sum(1))[:, None]
            share = part.sum(0) / rows[:, 3].sum()
        share[2] = max(share[2], 1e-6)  # no text has probability 0
        found[b] = share / share.sum()
        if b:
            last = found[b]
    return found


def _score(tokens: int, types: int, docs: int, mix: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, body, counts, out in _with_counts(batches):
            word, pair, context, lengths, _ = _places(body, counts, out, False, docs)
            share = mix[np.minimum(_bucket(context), CONTEXTS - 1)]
            p = share[:, 0] * pair / np.maximum(context, 1) + share[:, 1] * word / max(tokens, 1) + share[:, 2] / (types + 1)
            start = np.cumsum(lengths) - lengths
            base = np.log10((word + 1) / (tokens + 1 * (types + 1)))
            columns = [pa.array(ids, pa.int64()), pa.array(lengths), pa.array(np.add.reduceat((word > 0).astype(np.int64), start)),
                       pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(np.log10(p), start))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])
    return work


def score(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Rows where ``training`` is true are learned from; null counts as false. Tokens are the words of a text
    between ASCII white space, A-Z lower-cased, then one end; a null text has the end only. n_known:
    tokens that training has seen; base_score: log10 probability with one added to each count; score:
    that of the interpolated model. With nothing to learn from, all words are equally likely: score 0.
    """
    role = F.when(~F.coalesce(training, F.lit(False)), 0).when(F.pmod(F.xxhash64("text"), F.lit(DELETED)) == 0, 2).otherwise(1)
    rows = docs.select(F.col("doc_id").cast("long"), "text", role.alias("role"))
    chunks = written(rows.mapInArrow(_chunks, _CHUNK), "none")
    names = ("train_tokens", "deleted_tokens", "train_docs", "deleted_docs", "bigrams")
    tokens, out_tokens, texts_, out_texts, grams = (v or 0 for v in chunks.agg(*[F.sum(n) for n in names]).first())
    count = max(1, -(-grams // BUCKET))
    asked = chunks.select("chunk", "body").mapInArrow(_ask({1: max(1, count // 4), 2: count}), _ASK)
    answers = written(asked.groupBy("level", "bucket").applyInArrow(_answer, _ANSWER), "none")
    types, main_types = (v or 0 for v in answers.filter("level = 1").agg(F.sum("types"), F.sum("main_types")).first())
    seen = _met(chunks.filter("deleted"), answers).mapInArrow(
        _left_out_grid(tokens - out_tokens, texts_ - out_texts), "bucket long, two long, one long, n long")
    grid = seen.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    # At most CONTEXTS x the steps of two probabilities, however many words were left out.
    cells = np.array([tuple(r) for r in grid.collect()], np.int64).reshape(-1, 4)
    mix = weights(cells, main_types) if tokens else np.tile([0.0, 0.0, 1.0], (CONTEXTS, 1))
    found = _met(chunks, answers).mapInArrow(_score(tokens, types, texts_, mix), _SCORE)
    return found.withColumn("train_tokens", F.lit(tokens).cast("long"))
