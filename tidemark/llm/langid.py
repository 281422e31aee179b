"""Language of words and texts: a linear-chain conditional random field.

Each word is a place of the chain, its label a language. Its score is a sum of learned weights of
its prefixes, suffixes, letter n-grams and of itself (the lexicon), found by hashing; transition
weights between neighbours' labels are learned with them. Forward-backward gives every word's label
probabilities in code-switched text. Training sequences are spliced from windows of texts of
different languages, so that changes of language within a text are seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Places, text_batches, texts

BITS = 18
#: Words of a lane: long texts are cut into lanes that run side by side and are joined exactly.
LANE = 64
#: Sample bound of training: texts per language, and words taken from the middle of a random place in each.
SAMPLE_TEXTS, SAMPLE_WORDS = 400, 160


def word_ids(docs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words, the place of each text's words in them, and words per text."""
    seen, lengths, ids = Places(), np.zeros(len(docs), np.int64), []
    for i, doc in enumerate(docs):
        words = doc.lower().split()
        lengths[i] = len(words)
        ids.append(np.array(list(map(seen.__getitem__, words)), np.int32))
    return list(seen), np.concatenate(ids) if ids else np.zeros(0, np.int32), lengths


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, one after the other, and where each word's begin.

    Of a word, as UTF-8 between two marks: itself, its 2- to 4-byte prefixes and suffixes and all
    its 2- and 3-byte n-grams. Bytes stand for letters; a two-byte letter is a 2-gram.
    """
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(raw)), length)
    at = np.arange(len(data)) - start[owner]
    left = length[owner] - at
    found, owners = [], []

    def add(code: np.ndarray, who: np.ndarray, kind: int):
        code = (code ^ np.uint64(kind * 0x9E3779B1)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((code >> np.uint64(64 - BITS)).astype(np.int32))
        owners.append(who)

    gram = data.copy()
    for n in range(2, 5):
        gram = gram[:-1] * np.uint64(257) + data[n - 1:] if len(gram) > 1 else gram[:0]
        fits = left[:len(gram)] >= n
        if n < 4:
            add(gram[fits], owner[:len(gram)][fits], n)
        first = fits & (at[:len(gram)] == 0)
        add(gram[first], owner[:len(gram)][first], 4 + n)
        last = fits & (left[:len(gram)] == n)
        add(gram[last], owner[:len(gram)][last], 8 + n)
    power = (np.uint64(0x100000001B3) ** np.minimum(at, 4000).astype(np.uint64))
    whole = np.add.reduceat(data * power, start) if len(raw) else np.zeros(0, np.uint64)
    add(whole, np.arange(len(raw)), 1)
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(raw))
    return found[order], np.cumsum(counts) - counts


def _scores(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """(words, labels) summed weights; words are taken in blocks to bound memory."""
    out = np.zeros((len(words), weights.shape[1]))
    for at in range(0, len(words), 50_000):
        code, start = features(words[at:at + 50_000])
        for label in range(weights.shape[1]):
            out[at:at + 50_000, label] = np.add.reduceat(weights[code, label], start)
    return out


def forward_backward(score: np.ndarray, lengths: np.ndarray, transition: np.ndarray, with_pairs: bool = True):
    """Label probabilities of each place, the summed pair probabilities, and the log of the chains' sums.

    ``score``: (places, labels) of all chains, one after the other. A chain is cut into lanes. All
    lanes run side by side three times: to the product of their matrices, then, from the chain's
    state at their start and end, forward and backward.
    """
    n_labels = score.shape[1]
    total = len(score)
    pairs = np.zeros((n_labels, n_labels))
    if total == 0:
        return np.zeros((0, n_labels)), pairs, 0.0
    top = score.max(1, keepdims=True)
    emit = np.exp(score - top)
    move = np.exp(transition)
    lengths = lengths[lengths > 0]
    n_lanes = -(-lengths // LANE)
    chain = np.repeat(np.arange(len(lengths)), n_lanes)
    rank = np.arange(len(chain)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
    begin = np.repeat(np.cumsum(lengths) - lengths, n_lanes) + rank * LANE
    size = np.minimum(LANE, lengths[chain] - rank * LANE)
    order = np.argsort(-size, kind="stable")
    begin_s, size_s = begin[order], size[order]
    active = [int(np.searchsorted(-size_s, -t, "left")) for t in range(LANE)]  # lanes longer than t

    # 1. The matrix of each lane: from the label before it to its last label.
    first = rank[order] == 0
    lane = np.broadcast_to(move, (len(order), n_labels, n_labels)).copy()
    lane[first] = 1.0  # a chain's first word has no transition
    lane *= emit[begin_s][:, None, :]
    for t in range(1, LANE):
        k = active[t]
        if k == 0:
            break
        step = (lane[:k].reshape(-1, n_labels) @ move).reshape(k, n_labels, n_labels) * emit[begin_s[:k] + t][:, None, :]
        lane[:k] = step / step.max((1, 2), keepdims=True)
    matrix = np.empty_like(lane)
    matrix[order] = lane

    # 2. The state before and after each lane, chain by chain side by side.
    ahead = np.full((len(chain), n_labels), 1.0 / n_labels)
    behind = np.ones((len(chain), n_labels))
    base = np.cumsum(n_lanes) - n_lanes
    by_size = np.argsort(-n_lanes, kind="stable")
    sizes = n_lanes[by_size]
    state = np.full((len(lengths), n_labels), 1.0 / n_labels)
    for j in range(1, int(sizes[0])):
        k = int(np.searchsorted(-sizes, -j, "left"))
        who = base[by_size[:k]] + j - 1
        state = np.einsum("ki,kij->kj", state[:k], matrix[who])
        state /= state.sum(1, keepdims=True)
        ahead[who + 1] = state
    for j in range(int(sizes[0]) - 2, -1, -1):
        k = int(np.searchsorted(-sizes, -(j + 1), "left"))
        who = base[by_size[:k]] + j
        after = np.einsum("kij,kj->ki", matrix[who + 1], behind[who + 1])
        behind[who] = after / after.sum(1, keepdims=True)

    # 3. Within the lanes.
    alpha = np.empty((total, n_labels))
    state = ahead[order] @ move
    state[first] = 1.0
    state *= emit[begin_s]
    log_sum = float(top.sum())
    scale = state.sum(1, keepdims=True)
    log_sum += float(np.log(scale).sum())
    state /= scale
    alpha[begin_s] = state
    for t in range(1, LANE):
        k = active[t]
        if k == 0:
            break
        state = (state[:k] @ move) * emit[begin_s[:k] + t]
        scale = state.sum(1, keepdims=True)
        log_sum += float(np.log(scale).sum())
        state /= scale
        alpha[begin_s[:k] + t] = state
    beta = np.empty((total, n_labels))
    after = behind[order].copy()
    for t in range(LANE - 1, -1, -1):
        k = active[t]
        if k == 0:
            continue
        here = begin_s[:k] + t
        beta[here] = after[:k]
        after[:k] = (emit[here] * after[:k]) @ move.T
        after[:k] /= after[:k].sum(1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(1, keepdims=True)
    inner = np.ones(total, bool)
    inner[np.cumsum(lengths) - lengths] = False
    here = np.flatnonzero(inner)
    if with_pairs and len(here):
        right = emit[here] * beta[here]
        both = alpha[here - 1][:, :, None] * move * right[:, None, :]
        pairs = (both / both.sum((1, 2), keepdims=True)).sum(0)
    return marginal, pairs, log_sum


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    transition: np.ndarray

    def words(self, docs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, word ids, words per text, and each word's label probabilities in place."""
        vocabulary, ids, lengths = word_ids(docs)
        score = _scores(self.weights, vocabulary)[ids] if vocabulary else np.zeros((0, len(self.labels)))
        return vocabulary, ids, lengths, forward_backward(score, lengths, self.transition, False)[0]

    def label_words(self, doc: str) -> list[tuple[str, str, float]]:
        """(word, language, probability) of each lower-cased word of one text."""
        vocabulary, ids, _, marginal = self.words([doc])
        best = marginal.argmax(1) if len(ids) else []
        return [(vocabulary[w], self.labels[b], float(m[b])) for w, b, m in zip(ids, best, marginal)]

    def label_texts(self, docs: list[str]) -> tuple[list[str], np.ndarray]:
        """The language with most probability over the words that have letters, and its part of it."""
        vocabulary, ids, lengths, marginal = self.words(docs)
        lettered = np.fromiter((any(map(str.isalpha, w)) for w in vocabulary), bool, len(vocabulary))
        mass = np.zeros((len(docs), len(self.labels)))
        kept = marginal * lettered[ids][:, None] if len(ids) else marginal
        some = lengths > 0
        if some.any():
            mass[some] = np.add.reduceat(kept, (np.cumsum(lengths) - lengths)[some])
        whole = mass.sum(1)
        best = mass.argmax(1)
        share = np.where(whole > 0, mass.max(1) / np.where(whole > 0, whole, 1), 0.0)
        return ["und" if w == 0 else self.labels[b] for w, b in zip(whole, best)], np.clip(share, 0, 1)


def fit(samples: list[tuple[str, str]], epochs: int = 6, rate: float = 0.3, seed: int = 7) -> Model:
    """A model from (text, language) windows: AdaGrad on the likelihood of spliced sequences."""
    labels = sorted({lang for _, lang in samples})
    label_of = {lang: i for i, lang in enumerate(labels)}
    weights = np.zeros((1 << BITS, max(1, len(labels))), np.float32)
    transition = np.zeros((weights.shape[1],) * 2)
    model = Model(labels, weights, transition)
    if len(labels) < 2:
        return model
    random = np.random.default_rng(seed)
    pieces = []  # runs of 5 to 40 words of one language
    for text, lang in samples:
        words = text.lower().split()
        at = 0
        while at < len(words):
            n = int(random.integers(5, 41))
            pieces.append((words[at:at + n], label_of[lang]))
            at += n
    squared, squared_t = np.full_like(weights, 1e-3), np.full_like(transition, 1e-3)
    for _ in range(epochs):
        order = random.permutation(len(pieces))
        for at in range(0, len(order), 512):
            chosen = [pieces[i] for i in order[at:at + 512]]
            # three runs make a sequence
            lengths = np.array([sum(len(p[0]) for p in chosen[i:i + 3]) for i in range(0, len(chosen), 3)])
            gold = np.concatenate([np.full(len(w), label) for w, label in chosen])
            vocabulary, ids, _ = word_ids([" ".join(w) for w, _ in chosen])
            code, start = features(vocabulary)
            score = np.add.reduceat(weights[code], start)[ids]
            marginal, pairs, _ = forward_backward(score, lengths, transition)
            slope = -marginal
            slope[np.arange(len(gold)), gold] += 1
            by_word = np.zeros((len(vocabulary), len(labels)))
            np.add.at(by_word, ids, slope)
            owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.r_[start, len(code)]))
            touched, place = np.unique(code, return_inverse=True)
            for label in range(len(labels)):
                g = np.bincount(place, by_word[owner, label], len(touched)) - 1e-3 * weights[touched, label]
                squared[touched, label] += g * g
                weights[touched, label] += rate * g / np.sqrt(squared[touched, label])
            inner = np.ones(len(gold), bool)
            inner[np.cumsum(lengths) - lengths] = False
            here = np.flatnonzero(inner)
            observed = np.zeros_like(transition)
            np.add.at(observed, (gold[here - 1], gold[here]), 1)
            g = observed - pairs - 1e-3 * transition
            squared_t += g * g
            transition += rate * g / np.sqrt(squared_t)
    return model


def sample(docs: DataFrame, label: str = "lang", per_label: int = SAMPLE_TEXTS, words: int = SAMPLE_WORDS) -> list[tuple[str, str]]:
    """At most ``per_label`` windows of ``words`` words for each label, from the rows of least hashed id.

    The window starts at a place that the text's hash picks; blank texts give none. Ids are chosen
    before texts are read, by a bounded sort to which every task sends ``per_label`` numbers at most. Rows
    without an id or a label are not learned from; of equal ids as many rows as are chosen take part.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("string").alias("lang"), "text")
    rows = rows.filter("doc_id is not null and lang is not null")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not languages:
        return []
    least = [rows.filter(F.col("lang") == x).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for x in languages]
    chosen = least[0]
    for more in least[1:]:
        chosen = chosen.union(more)
    split = F.split(F.col("text"), r"\s+")
    at = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.size(split) - words)).cast("int") + 1
    found = rows.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).filter("trim(text) <> ''")
    found = found.select(F.array_join(F.slice(split, at, words), " ").alias("text"), "lang", F.xxhash64("text").alias("h"))
    return [(r[0], r[1]) for r in found.orderBy("h", "lang").limit(per_label * len(languages)).collect()]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text), from the whole text alone.

    score is the best language's part of the label probabilities of words with letters. A text that
    is null or has no letters is ``und`` with score 0; so is every text if no label was learned.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            docs = texts(batch)
            if model.labels:
                labels, share = model.label_texts(docs)
            else:
                labels, share = ["und"] * len(docs), np.zeros(len(docs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(share, pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, share: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in whose text a language has at least ``share`` of the
    label probabilities. Null texts and those without letters go; without learned labels no others do."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            docs = texts(batch)
            if model.labels:
                labels, found = model.label_texts(docs)
                good = [label != "und" and part >= share for label, part in zip(labels, found)]
            else:
                good = [any(map(str.isalpha, t)) for t in docs]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
