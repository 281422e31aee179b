"""Context-triggered piecewise hashes: signatures that survive local edits.

A hash rolls over the last 7 bytes; where its lowest bits are all ones, a chunk ends. The number of
bits is the smallest that gives at most 64 ends, so block sizes are powers of two. Each chunk adds
one of 64 letters to the signature, and a second signature is made at twice the block size, so that
texts whose sizes differ by up to a factor of two or so can be compared by edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, text_batches, texts

WINDOW = 7
CHUNKS = 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes whose hashes are computed at once.
SPAN = 1 << 20

OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "next_fingerprint string")


def _levels(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a chunk of some size ends, and for how many trailing ones each counts."""
    places, levels = [], []
    least = max(0, len(data).bit_length() - 10)  # fewer ones than these give far over 64 ends
    while True:
        mask = np.uint32((1 << least) - 1)
        for at in range(0, len(data), SPAN):
            span = data[max(0, at - WINDOW + 1):at + SPAN].astype(np.uint32)
            rolled = span.copy()
            for k in range(1, WINDOW):
                rolled *= np.uint32(0x01000193)
                rolled[k:] += span[:-k] if k < len(span) else 0
            rolled ^= rolled >> np.uint32(15)
            rolled *= np.uint32(0x2C1B3C6D)
            rolled ^= rolled >> np.uint32(13)
            skip = min(at, WINDOW - 1)
            rolled = rolled[skip:]
            hit = np.flatnonzero((rolled & mask) == mask)
            inverse = ~rolled[hit]
            ones = np.bitwise_count((inverse & (~inverse + np.uint32(1))) - np.uint32(1))
            places.append(hit + at)
            levels.append(ones)
        if sum(map(len, places)) > CHUNKS or least == 0:
            return np.concatenate(places), np.concatenate(levels)
        least, places, levels = max(0, least - 4), [], []


def fingerprint(text: str) -> str:
    """``block:signature:signature at twice the block``; equal for equal texts, ``1::`` for the empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return "1::"
    places, levels = _levels(np.frombuffer(raw, np.uint8))
    level = 0
    while np.count_nonzero(levels >= level) > CHUNKS:
        level += 1

    def signature(ones: int) -> str:
        ends = (places[levels >= ones] + 1).tolist()
        if not ends or ends[-1] < len(raw):
            ends.append(len(raw))
        return "".join([LETTERS[xxhash.xxh32_intdigest(raw[s:e]) & 63] for s, e in zip([0, *ends], ends)])

    return f"{1 << level}:{signature(level)}:{signature(level + 1)}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the edit distance of the signatures at a common block size, as a part of the
    longer one; the better of two common sizes, 0 without one, 1 for equal fingerprints."""
    def parts(c):
        return F.split(c, ":")

    size_a, size_b = (parts(c)[0].cast("long") for c in (a, b))

    def like(x, y):
        longest = F.greatest(F.length(x), F.length(y))
        return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / longest)

    return (
        F.when(a == b, 1.0)
        .when(size_a == size_b, F.greatest(like(parts(a)[1], parts(b)[1]), like(parts(a)[2], parts(b)[2])))
        .when(size_a == 2 * size_b, like(parts(a)[1], parts(b)[2]))
        .when(size_b == 2 * size_a, like(parts(a)[2], parts(b)[1]))
        .otherwise(0.0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row's whole text; a null text counts as empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = pa.array([fingerprint(t) for t in texts(batch)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, fingerprint string")


#: Order of the rows: null ids first, then by id, rows of one id by a hash of their texts.
_ORDER = [("known", np.int8), ("id", np.int64), ("mark", np.int64)]


def _with_heads(heads: list[tuple[int, int, int]]):
    """Rows with their range; the first rows of a range go to the range before too, as ``guest``."""
    starts = np.array(heads, _ORDER)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            order = np.empty(batch.num_rows, _ORDER)
            order["known"] = ids.is_valid().to_numpy(zero_copy_only=False)
            order["id"], order["mark"] = ids.fill_null(0).to_numpy(), batch.column("mark").to_numpy()
            place = np.searchsorted(starts, order, "right") - 1
            own = np.maximum(place, 0)
            # the first rows of all are guests of the last range
            guests = np.flatnonzero((place >= 0) & (starts[own] == order))
            rows = np.r_[np.arange(len(own)), guests]
            where = np.r_[own, (own[guests] - 1) % len(starts)]
            guest = np.r_[np.zeros(len(own), bool), np.ones(len(guests), bool)]
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(where.astype(np.int32)), pa.array(guest), *taken.columns], ["range", "guest", "doc_id", "text", "mark"])
    return work


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # (range, doc_id, text, fingerprint) of the row that waits for its successor
    for batch in text_batches(batches):
        out = []
        for where, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            if guest and (held is None or held[0] != where):
                continue
            mark = fingerprint(text)
            if held is not None and held[0] == where:
                own = held[2]
                cut = len(own) // 4
                edited = own[:len(own) - cut] + text[:cut]
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((held[1], len(own), digest, held[3], fingerprint(edited), mark))
            held = None if guest else (where, doc_id, text, mark)
        columns = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text and of its successor, in order of doc_id.

    The edited text has its last floor(n/4) of n code points replaced by the first as many (or all) of
    the successor's text; the last row's successor is the first. Null ids come first, equal ids are
    ordered by a hash of their texts. A null text is empty. One row results per input row.

    The texts are shuffled once. Ranges of (id, hash) come from a shuffle of these alone, whose smallest
    ones (one per task) are all that the driver sees; each range also receives the first row of the next.
    So many rows without an id, or of one id, are dealt over ranges; only equal rows stay together.
    """
    known, id_ = F.col("doc_id").isNotNull().cast("byte"), F.coalesce("doc_id", F.lit(0).cast("long"))
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    order = docs.select(known.alias("known"), id_.alias("id"), "mark")
    order = order.repartitionByRange(partitions(docs.sparkSession), "known", "id", "mark")
    least = order.groupBy(F.spark_partition_id()).agg(F.min(F.struct("known", "id", "mark")).alias("head"))
    heads = sorted(tuple(r["head"]) for r in least.collect()) or [(0, 0, 0)]
    dealt = docs.mapInArrow(_with_heads(heads), "range int, guest boolean, doc_id long, text string, mark long")
    dealt = dealt.repartitionById(len(heads), F.col("range")).sortWithinPartitions("range", "guest", F.asc_nulls_first("doc_id"), "mark")
    found = dealt.drop("mark").mapInArrow(_pairs, OUT)
    return found.withColumns({
        "near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")),
        "near_next": likeness(F.col("fingerprint"), F.col("next_fingerprint")),
    }).drop("next_fingerprint")
