"""Interpolated language model and byte-level BPE against plain computations; the pipeline."""

import base64
import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import byte_bpe, interpolation, langid, line_join, packing, queries, quality, simhash
from tidemark.llm.packed import least_type, pack, unpack

P = pytest.importorskip("public_tokenizers")
SF_DIR = "/root/testdata/sf0.001"


def test_packed_numbers():
    for a in ([], [0], [3, 1, 2], [2**64 - 1, 0, 5]):
        a = np.array(a, np.uint64)
        assert unpack(pack(a)).tolist() == a.tolist()
        assert unpack(pack(np.sort(a), True)).tolist() == np.sort(a).tolist()
    assert least_type(np.array([1, 300])).dtype == np.uint16 and unpack(pack(least_type(np.zeros(0, np.int64)))).tolist() == []


def words(text):
    return (text or "").encode().lower().split() + [b"\n"]


def rows_of(n, seed):
    pick = random.Random(seed)
    vocabulary = [f"w{int(pick.paretovariate(0.7)) % 300}" for _ in range(400)]
    return [(i, " ".join(pick.choice(vocabulary) for _ in range(pick.randint(0, 60)))) for i in range(n)] + [
        (None, "W1 w2"), (7, "w1 w1"), (7, "w1 w1"), (900, None), (901, " \n"), (902, "w1 unseenword " * 5000)]


@pytest.mark.parametrize("chunk,bucket", [(1_500_000, 2_000_000), (200, 50)])
def test_interpolation_counts_and_scores(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(interpolation, "CHUNK", chunk)
    monkeypatch.setattr(interpolation, "BUCKET", bucket)
    rows = rows_of(150, 1)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    taught = [t for i, t in rows if i is not None and i % 3 and i < 900]
    found = interpolation.score(frame, (F.col("doc_id") % 3 != 0) & (F.col("doc_id") < 900)).collect()
    one = Counter(w for t in taught for w in words(t))
    two = Counter(p for t in taught for p in zip([b"\t", *words(t)], words(t)))
    n, v = sum(one.values()), len(one)
    want = sorted((i, len(words(t)), sum(one[w] > 0 for w in words(t)), n, round(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows if i is not None)
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found if r.doc_id is not None)
    assert got == want and len(found) == len(rows)
    # The mixture, from the left-out part's grid by hand.
    out = [t for t in taught if is_left_out(spark, t)]
    kept_one, kept_two = one - Counter(w for t in out for w in words(t)), two - Counter(p for t in out for p in zip([b"\t", *words(t)], words(t)))
    kept_n, starts = sum(kept_one.values()), len(taught) - len(out)
    grid = Counter()
    for t in out:
        for a, w in zip([b"\t", *words(t)], words(t)):
            c = starts if a == b"\t" else kept_one[a]
            grid[(0 if c == 0 else int(math.log2(c)) + 1, round(-8 * math.log2(kept_two[a, w] / c)) if kept_two[a, w] else -1,
                  round(-8 * math.log2(kept_one[w] / kept_n)) if kept_one[w] else -1)] += 1
    mix = interpolation.weights(np.array([(*k, c) for k, c in grid.items()]).reshape(-1, 4), len(+kept_one))
    for r in found:
        if r.doc_id in (0, 5, 900, 902):
            total = 0.0
            for a, w in zip([b"\t", *words(dict(rows)[r.doc_id])], words(dict(rows)[r.doc_id])):
                c = len(taught) if a == b"\t" else one[a]
                m = mix[0 if c == 0 else int(math.log2(c)) + 1]
                total += math.log10(m[0] * two[a, w] / max(c, 1) + m[1] * one[w] / n + m[2] / (v + 1))
            assert r.score == pytest.approx(total)


def is_left_out(spark, text):
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(text)), F.lit(interpolation.DELETED))).first()[0] == 0


def test_weights_climb_to_the_likelihood_maximum():
    grid = np.array([(3, 8, 40, 70), (3, -1, 32, 30)])
    mix = interpolation.weights(grid, 1000)[3]

    def likelihood(m):
        p = [m[0] * 0.5 + m[1] * 2.0**-5 + m[2] / 1001, m[1] * 2.0**-4 + m[2] / 1001]
        return 70 * math.log(max(p[0], 1e-300)) + 30 * math.log(max(p[1], 1e-300))
    assert mix.sum() == pytest.approx(1)
    assert likelihood(mix) >= max(likelihood((a / 50, b / 50, 1 - a / 50 - b / 50)) for a in range(51) for b in range(51 - a)) - 1e-3
    assert interpolation.weights(np.zeros((0, 4), int), 5)[0][0] == 0


def test_interpolation_without_training_or_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, round(r.score, 9)) for r in interpolation.score(frame, F.lit(False)).collect()) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert interpolation.score(frame.limit(0), F.lit(True)).collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.read(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_texts():
    pick = random.Random(5)
    letters = "ab \t\n\x0b\x1c\x1d\x85\xa0\u3000\u200b\u2028'sllé1²Ⅷ٣#$日本語\U0001f600\u0301ß٠"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(300)]
    return texts + [None, "", "<|endoftext|>", "don't we'll", "a" * 3000, "=" * 5000, " " * 4000, "日本" * 1200,
                    "".join(pick.choice("abcdefghij") for _ in range(1500)), "word " * 20_000]


def test_bpe_equals_the_library(spark, vocabulary, library):
    texts = bpe_texts()
    frame = spark.createDataFrame([(i if i else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    want = {(i if i else None): library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    ids = byte_bpe.encode(frame, vocabulary)
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    assert {r.doc_id: bytes(r.data) for r in byte_bpe.decode(ids, vocabulary).collect()} == {(i if i else None): (t or "").encode() for i, t in enumerate(texts)}
    for r in byte_bpe.round_trip(frame, vocabulary).collect():
        text = (texts[r.doc_id or 0] or "").encode()
        assert (r.n_tokens, r.decoded_sha256) == (len(want[r.doc_id]), hashlib.sha256(text).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest()
    assert byte_bpe.round_trip(frame.limit(0), vocabulary).collect() == []


@pytest.mark.parametrize("name", ["random", "random 60k", "runs", "words", "marks"])
def test_long_words_equal_the_library(spark, vocabulary, library, name):
    """A word of tens of thousands of bytes takes seconds, whatever it is made of."""
    pick = random.Random(name)
    word = {
        "random": lambda: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)),
        "random 60k": lambda: "".join(pick.choice("abcdefghijklmnopqrstuvwxyzäöüß") for _ in range(50_000)),
        "runs": lambda: "".join(pick.choice("ab") * pick.randint(1, 300) for _ in range(150)),
        "words": lambda: "".join(pick.choice(["the", "and", "tion", "er", "ing", "quality", "zz"]) for _ in range(6_000)),
        "marks": lambda: "".join(pick.choice(["=", "-", "=-", "--", "*"]) * pick.randint(1, 200) for _ in range(120)),
    }[name]()
    coder, began = byte_bpe.Coder(vocabulary), time.monotonic()
    ids, counts = coder.encode([b"short", word.encode(), b" words"])
    want = [library.encode_single_token("short"), *library.encode_ordinary(word), library.encode_single_token(" words")]
    assert ids.tolist() == want and counts.tolist() == [1, len(want) - 2, 1]
    assert coder.decode_words(ids, counts) == [b"short", word.encode(), b" words"]
    assert time.monotonic() - began < 60


def test_words_are_kept_from_task_to_task(vocabulary, library):
    """Within a process; after a task that broke off they are met anew."""
    import pyarrow as pa
    byte_bpe._kept().pop((vocabulary.digest, True), None)
    batch = pa.RecordBatch.from_pydict({"text": ["unusualword and unusualword", None, "x" * 700]})
    sizes = []
    for _ in range(2):
        for _, docs, words in byte_bpe._encoded(vocabulary, iter([batch, batch]), decoded=True):
            assert [words.ids_of(d).tolist() for d in docs] == [library.encode_ordinary(t or "") for t in batch.column("text").to_pylist()]
        sizes.append(len(words.counts))
    assert sizes[0] == sizes[1] == len(words.data)
    broken = byte_bpe._encoded(vocabulary, iter([batch]), decoded=True)
    next(broken)
    broken.close()
    assert (vocabulary.digest, True) not in byte_bpe._kept()


def test_bpe_forgets_and_goes_on(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(byte_bpe, "SLICE", 20)
    monkeypatch.setattr(byte_bpe, "LONG", 4)
    monkeypatch.setattr(byte_bpe, "LONG_ROWS", 10)
    texts = ["hello unusualword", "another unusualword here", "banana bandana"] * 4
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in byte_bpe.encode(frame, vocabulary).collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


def test_unknown_ids_are_an_error(vocabulary):
    with pytest.raises(ValueError, match="not in the vocabulary"):
        byte_bpe.Coder(vocabulary).decode([[99_999_999]])


def test_pipeline_stage_by_stage(spark):
    """Each stage over all that its predecessor kept, against the operator's plain counterpart."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "line_dedup", "near_dedup", "packing"]
    first = corpus_pipeline.language(spark, docs, SF_DIR).cache()
    model = langid.fit(langid.sample(docs))
    kept = {r.doc_id for r in docs.collect() if (lambda l, s: l[0] != "und" and s[0] >= corpus_pipeline.LANGUAGE_SHARE)(*model.label_texts([r.text]))}
    assert {r.doc_id for r in first.collect()} == kept and first.columns == docs.columns
    second = corpus_pipeline.good_quality(spark, first, SF_DIR).cache()
    scorer = quality.fit(*quality.sample(first, labels))
    kept = {r.doc_id for r in first.collect() if scorer.scores(np.array([quality.features(r.text)]))[0] >= 0.5}
    assert {r.doc_id for r in second.collect()} == kept and second.columns == docs.columns
    third = corpus_pipeline.line_dedup(spark, second, SF_DIR).cache()
    from test_llm_fingerprints import brute_components, brute_lines, brute_simhash  # noqa: F401
    want = {r[0]: r[1] for r in brute_lines([(r.doc_id, r.text, 0) for r in second.orderBy("doc_id").collect()], least=1) if not (r[4] and not r[1].strip())}
    assert {r.doc_id: r.text for r in third.collect()} == want and third.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in third.collect())
    fourth = corpus_pipeline.near_dedup(spark, third, SF_DIR).cache()
    groups = brute_components([(r.doc_id, r.text, 0) for r in third.collect()])
    assert {r.doc_id for r in fourth.collect()} == {i for i, _, c in groups if i == c} and fourth.columns == docs.columns
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert whole.columns == ["doc_id", "piece", "size", "bin", "start"]
    sizes = {}
    for r in whole.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r["size"]
    assert sizes == {r.doc_id: len(r.text) for r in fourth.collect()}


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.collect() == []


def test_sql_of_the_queries(spark):
    from compare import compare, tables

    for name, sql in queries.SQL.items():
        compare(queries.QUERIES[name](spark, SF_DIR), tables(SF_DIR), sql)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_keep_every_row(spark, name):
    found = queries.QUERIES[name](spark, SF_DIR)
    rows = found.count()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    if name == "op8_nearest":
        assert rows == 25 * 20
    elif name == "op7_url_rules":
        assert rows == spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
    else:
        assert rows >= docs and found.select("doc_id").distinct().count() == docs
