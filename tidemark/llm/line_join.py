"""Line dedup by an exact set-similarity join: removes lines that match an earlier line.

A line is the set of its lower-cased words. Words are ordered by rarity; two sets of Jaccard
similarity t must share a word among the first of each (prefix filter), be of similar length (length
filter), and have enough words left from the first shared one on (positional filter). A parity bitmap of each
set bounds the difference of two sets once more. Lines that pass form families; within a family,
Jaccard is computed and every line that has an earlier match goes.

Texts are cut into chunks, written once with all columns as compressed bytes. Lines are known by chunk
and place, and sets travel only for lines of families.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import chunk_numbers, components, partitions, text_batches, written
from tidemark.llm.packed import least_type, pack, unpack

SIMILARITY = 0.8
#: Least distinct words of the lines that take part, unless ``dedup`` is told otherwise.
LEAST_WORDS = 1
#: Words of a chunk, postings of a bucket of the hash range, lines of a family that meet in one task.
CHUNK, BUCKET, FAMILY = 1_000_000, 400_000, 20_000
#: Postings of a word in one chunk from which on the chunk names it; words that then have more than a bucket
#: are hot, and their postings meet in pairs of blocks of half a bucket.
NAMED = 8
#: A word is frequent if it is one in so many at least; there are no more frequent words than that.
FREQUENT = 1 << 18
#: Rows of families that a task holds at once.
ROWS = 150_000
#: A line's number: that of its chunk, then its place there.
PLACES = 24
#: Words beyond which a line's bitmap has 256 bits, not 64.
WIDE = 80
#: Words hashed at once.
PIECE = 1 << 15
#: Masks that leave the first 0 to 8 bytes of a number.
_EIGHTS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

_CHUNK = "chunk long, body binary, twins binary, words binary, counts binary, tokens long, postings long"
_POSTINGS = "bucket long, side int, chunk long, word binary, line binary, size binary, place binary, bitmap binary, wide binary"


def _prefix(size: np.ndarray, t: float) -> np.ndarray:
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _overlap(a: np.ndarray, b: np.ndarray | int, t: float) -> np.ndarray:
    """The least number of common words of sets of sizes a and b with similarity t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)


def _core(size: np.ndarray, place: np.ndarray, t: float) -> np.ndarray:
    """Whether a set whose first shared word stands at ``place`` can match one of its own size. Two sets of
    which neither can never match, whatever their sizes."""
    return size - place >= _overlap(size, size, t)


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, and where each text starts; last, where all end."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1] or bytes(8), kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return data, ends - ends[0]


def _hashes(words: pa.Array, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: its bytes by eight as numbers, mixed, over all words at
    once. Words lie from ``starts`` to ``ends``; if these are not given, each text is a word."""
    data, bounds = _text_bytes(words)
    starts, ends = (bounds[:-1], bounds[1:]) if starts is None else (starts, ends)
    lower = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    lower[:len(data)] = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    digits, sizes = lower.view("<u8"), ends - starts
    found = sizes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for first in range(0, len(starts), PIECE):
        piece, start, left = (v[first:first + PIECE] for v in (found, starts, sizes))
        at = slice(None)
        while len(start):
            place, shift = start >> 3, (start & 7).astype(np.uint64) << np.uint64(3)
            eight = (digits[place] >> shift) | (digits[place + 1] << np.uint64(1) << (np.uint64(63) - shift))
            mixed = (piece[at] ^ (eight & _EIGHTS[np.minimum(left, 8)])) * np.uint64(0x9E3779B97F4A7C15)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
            piece[at] = mixed ^ (mixed >> np.uint64(31))
            # Words of more bytes go on with the next eight.
            more = np.flatnonzero(left > 8)
            at = more if isinstance(at, slice) else at[more]
            start, left = start[more] + 8, left[more] - 8
    return found


class _Lines:
    """The words of each line that takes part, as local numbers, and the line's place."""

    def __init__(self, column: pa.Array, least: int, only: np.ndarray | None = None):
        """``column``: texts, null without lines. ``only``: places of lines to look at, ascending."""
        self.least = least
        there = column.is_valid().to_numpy(zero_copy_only=False)
        column = column.fill_null("") if column.null_count else column
        data, ends = _text_bytes(column)
        feeds = np.flatnonzero(data == 10)
        # A line starts where its text does or after a line feed; of lines with one start the last has the words.
        lines = np.sort(np.r_[ends[:-1][there], feeds + 1], kind="stable")
        doc = np.repeat(np.arange(len(column)), np.where(there, np.diff(np.searchsorted(feeds, ends)) + 1, 0))
        letter = np.zeros(len(data) + 1, bool)
        letter[:-1] = (data != 32) & (data - np.uint8(9) > 4)
        starts, stops = letter[:-1].copy(), letter[:-1].copy()
        starts[1:] &= ~letter[:-2]
        stops &= ~letter[1:]
        # Words do not go on in the next text.
        bounds = ends[:-1][np.diff(ends) > 0]
        starts[bounds] = letter[bounds]
        stops[bounds[1:] - 1] = letter[bounds[1:] - 1]
        starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        cuts = np.r_[np.searchsorted(starts, lines), len(starts)]
        count = np.diff(cuts)
        enough = count >= least
        if only is not None:
            enough &= np.bincount(only, minlength=len(lines)) > 0
        taking = np.flatnonzero(enough)
        if least > 1 or only is not None:
            asked = np.repeat(enough, count)
            starts, stops = starts[asked], stops[asked]
        hashes = _hashes(column, starts, stops)
        self.owner = np.repeat(np.arange(len(taking)), count[taking])
        coded = pa.array(hashes).dictionary_encode()
        self.words = coded.indices.to_numpy().astype(np.int64)
        self.hashes = coded.dictionary.to_numpy()
        self.counts = np.bincount(self.words, minlength=len(self.hashes))
        self.line = taking
        self.doc = doc[taking]

    def sets(self, priority: np.ndarray | None = None, asked: np.ndarray | None = None):
        """(word, start, size) of the lines' sets in ascending priority; lines of few words are left out.

        Also which lines those are. Priorities of different words must differ; without them, words come in
        any order. ``asked``: a flag for each line; the others are left out too.
        """
        owner, words = self.owner, self.words
        if asked is not None:
            at = np.flatnonzero(asked[owner])
            owner, words = owner[at], words[at]
        if priority is not None:
            order = np.argsort(priority)
            dense = np.empty(len(order), np.int64)
            dense[order] = np.arange(len(order))
            words = dense[words]
        keys = np.sort(owner << 32 | words)
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
        owner, word = keys >> 32, keys & 0xFFFFFFFF
        word = word if priority is None else order[word]
        size = np.bincount(owner, minlength=len(self.line))
        enough = size >= (self.least if asked is None else max(1, self.least))
        word, kept = word[enough[owner]], np.flatnonzero(enough)
        size = size[kept]
        return word, np.cumsum(size) - size, size, kept


def _set_hashes(hashes: np.ndarray, word: np.ndarray, start: np.ndarray) -> np.ndarray:
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return np.add.reduceat((mixed ^ (mixed >> np.uint64(31)))[word], start) if len(start) else np.zeros(0, np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (hashes & np.uint64(63))


def _bitmaps(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each set the parities of its words in 256 bits, as four numbers; those xor-ed are its parities in
    64. Bits that differ are at most as many as words that only one of two sets has."""
    bit, part = _bits(hashes), (hashes >> np.uint64(6)) & np.uint64(3)
    if not len(start):
        return np.zeros((0, 4), np.uint64)
    return np.stack([np.bitwise_xor.reduceat(np.where(part == np.uint64(i), bit, np.uint64(0)), start) for i in range(4)], 1)


def _folded(bitmaps: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(bitmaps, axis=1)


def _differing(bitmaps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bitmaps[a] ^ bitmaps[b]).sum(1, dtype=np.int64)


def _pack_batch(batch: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_table(batch)
    return zstandard.ZstdCompressor(level=2).compress(sink.getvalue().to_pybytes())


def _unpack_batch(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all().combine_chunks()


def _texts(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _order(table: pa.Table) -> np.ndarray:
    """Sort values of the ids: null first."""
    ids = table.column("doc_id").combine_chunks()
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, ids.fill_null(0).to_numpy(zero_copy_only=False))


def _chunks(t: float, least: int):
    def row(batches: list[pa.RecordBatch], name: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        lines = _Lines(_texts(table), least)
        word, start, size, kept = lines.sets()
        # Of equal sets in this chunk the first in order stays; the others are its twins.
        sets = _set_hashes(lines.hashes, word, start)
        order = np.lexsort((lines.line[kept], _order(table)[lines.doc[kept]], sets))
        twin = np.r_[False, sets[order][1:] == sets[order][:-1]] if len(order) else np.zeros(0, bool)
        twins = np.sort(lines.line[kept][order[twin]])
        postings = int(_prefix(size[order[~twin]], t).sum())
        often = np.flatnonzero(lines.counts * 2 * FREQUENT >= lines.counts.sum())
        often = often[np.argsort(lines.hashes[often])]
        if len(lines.line) and int(lines.line.max()) >> PLACES:
            raise ValueError(f"a chunk has {int(lines.line.max()) + 1} lines; {1 << PLACES} have numbers")
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64()), *(pa.array([b], pa.binary()) for b in (
                _pack_batch(table), pack(twins.astype(np.uint32), True), pack(lines.hashes[often], True), pack(least_type(lines.counts[often])))),
             pa.array([int(lines.counts.sum())], pa.int64()), pa.array([postings], pa.int64())],
            ["chunk", "body", "twins", "words", "counts", "tokens", "postings"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = chunk_numbers(), [], 0
        for batch in text_batches(batches, 1 << 20):
            held.append(batch)
            size += batch.nbytes
            if size >= 7 * CHUNK:
                yield row(held, next(names))
                held, size = [], 0
        if held:
            yield row(held, next(names))
    return work


def _frequent(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the frequent words, rarest first. Each chunk names its own, so that no word that is one in
    ``FREQUENT`` over all is missed by all chunks, and at most ``FREQUENT`` words come together.

    Also how often each occurs at most, and how often any other word does: what a chunk does not name are
    fewer than one in twice ``FREQUENT`` of its words.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unpack(words).view(np.int64)), pa.array(unpack(counts).astype(np.int64))], ["word", "n"])

    total = chunks.agg(F.sum("tokens")).first()[0] or 0
    words = chunks.select("words", "counts").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = words.filter(F.col("n") * FREQUENT >= total).orderBy(F.desc("n"), "word").limit(FREQUENT)
    found = np.array([tuple(r) for r in words.collect()][::-1], np.int64).reshape(-1, 2)
    unnamed = total // (2 * FREQUENT) + 1
    return found[:, 0].copy().view(np.uint64), found[:, 1] + unnamed, total // FREQUENT + 1 + unnamed


def _may_hold(lines: _Lines, last: np.ndarray, t: float) -> np.ndarray:
    """Whether a line's prefix may hold one of the words ``last`` (flags), which come after all others: not if
    its other words set as many of 64 bits as its prefix has words, since different words are no fewer."""
    if not len(lines.owner):
        return np.zeros(len(lines.line), bool)
    bit = np.where(last, np.uint64(0), _bits(lines.hashes))
    tokens = np.bincount(lines.owner, minlength=len(lines.line))
    there = np.flatnonzero(tokens)
    found = np.zeros(len(tokens), bool)
    bits = np.bitwise_or.reduceat(bit[lines.words], (np.cumsum(tokens) - tokens)[there])
    found[there] = np.bitwise_count(bits) < _prefix(tokens[there], t)
    return found


def _hot(
        chunks: DataFrame, frequent: np.ndarray, most: np.ndarray, others: int, buckets: int, t: float, least: int) -> tuple[np.ndarray, ...]:
    """(word, blocks of cores, blocks of tails, first bucket) of the words with more postings than a bucket.

    Counts decide how postings are dealt, not which meet. Where only some frequent words occur often
    enough for that, these are the last in every set, and only lines whose prefix may hold one are counted.
    """
    able = frequent[most > BUCKET] if others <= BUCKET else None
    if buckets == 1 or (able is not None and not len(able)):  # no word has more than all have
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, twins in zip(*(batch.column(c).to_pylist() for c in ("body", "twins"))):
                lines = _Lines(_texts(_unpack_batch(body)), least)
                asked = None if able is None else _may_hold(lines, np.isin(lines.hashes, able), t)
                word, start, size, kept = lines.sets(_priority(lines.hashes, frequent), asked)
                count = np.where(np.isin(lines.line[kept], unpack(twins)), 0, _prefix(size, t))
                owner = np.repeat(np.arange(len(size)), count)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                first, core = word[start[owner] + place], _core(size[owner], place, t)
                cores, tails = (np.bincount(first[c], minlength=len(lines.hashes)) for c in (core, ~core))
                named = np.flatnonzero(cores + tails >= NAMED)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lines.hashes[named].view(np.int64)), pa.array(cores[named]), pa.array(tails[named])], ["word", "cores", "tails"])

    words = chunks.select("body", "twins").mapInArrow(work, "word long, cores long, tails long")
    words = words.groupBy("word").agg(F.sum("cores").alias("cores"), F.sum("tails").alias("tails")).filter(F.col("cores") + F.col("tails") > BUCKET)
    found = np.array([tuple(r) for r in words.collect()], np.int64).reshape(-1, 3)
    word = found[:, 0].copy().view(np.uint64)
    order = np.argsort(word)
    half = max(1, BUCKET // 2)
    cores, tails = (np.maximum(1, -(-found[order, i] // half)) for i in (1, 2))
    n = cores * (cores + 1) // 2 + cores * tails
    return word[order], cores, tails, buckets + np.cumsum(n) - n


def _dealt(core: bool, blocks: int, others: int, block: int) -> list[tuple[int, int]]:
    """(task, side) of a hot word's block: cores meet cores and tails; side 0 compares with itself, 1 with 2."""
    if not core:
        return [(others * (others + 1) // 2 + i * blocks + block, 2) for i in range(others)]
    met = [(max(block, j) * (max(block, j) + 1) // 2 + min(block, j), 0 if j == block else 1 if j > block else 2) for j in range(blocks)]
    return met + [(blocks * (blocks + 1) // 2 + block * others + j, 1) for j in range(others)]


def _priority(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Words that are not frequent come first, by hash; then the frequent ones, rarest first."""
    if not len(frequent):
        return hashes >> np.uint64(1)
    if not len(hashes):
        return hashes
    order = np.argsort(hashes)
    at = order[np.minimum(np.searchsorted(hashes[order], frequent), len(hashes) - 1)]
    hit = np.flatnonzero(hashes[at] == frequent)
    found = hashes >> np.uint64(1)
    found[at[hit]] = np.uint64(1 << 63) + hit.astype(np.uint64)
    return found


def _postings(frequent: np.ndarray, buckets: int, hot: tuple[np.ndarray, ...], t: float, least: int):
    hot_words, hot_cores, hot_tails, hot_buckets = hot
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body, twins in zip(*(batch.column(c).to_pylist() for c in ("chunk", "body", "twins"))):
                lines = _Lines(_texts(_unpack_batch(body)), least)
                word, start, size, kept = lines.sets(_priority(lines.hashes, frequent))
                if not len(size):
                    continue
                first = ~np.isin(lines.line[kept], unpack(twins))
                wide = np.flatnonzero(size > WIDE)
                bitmaps = np.zeros((len(size), 4), np.uint64)
                bitmaps[:, 0] = np.bitwise_xor.reduceat(_bits(lines.hashes)[word], start)
                bitmaps[wide] = _bitmaps(lines.hashes[word[np.repeat(size > WIDE, size)]], np.cumsum(size[wide]) - size[wide])
                count = np.where(first, _prefix(size, t), 0)
                owner = np.repeat(np.arange(len(size)), count)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                key = lines.hashes[word[start[owner] + place]]
                order = np.argsort(key, kind="stable")
                key, owner, place = key[order], owner[order], place[order]
                names, rows = lines.line[kept], []

                def row(bucket, side, at):
                    who = owner[at]
                    return (bucket, side, chunk, pack(key[at], True), pack(names[who].astype(np.uint32)), pack(least_type(size[who])),
                            pack(least_type(place[at])), pack(bitmaps[who, 0]), pack(bitmaps[who[size[who] > WIDE], 1:].ravel()))

                heated = np.isin(key, hot_words)
                rest = np.flatnonzero(~heated)
                cuts = np.r_[0, np.searchsorted(key[rest], edges), len(rest)]
                for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if hi > lo:
                        rows.append(row(b, 0, rest[lo:hi]))
                if rows:
                    yield batch_of(rows)
                # A chunk's lines go to four blocks at most, so that rows stay long.
                at = np.flatnonzero(heated)
                which = np.searchsorted(hot_words, key[at])
                core = _core(size[owner[at]], place[at], t)
                blocks = np.where(core, hot_cores[which], hot_tails[which])
                spread = (names[owner[at]] * 0x9E3779B1 >> 7) % np.minimum(blocks, 4)
                block = (chunk * 0x9E3779B1 % 0x7FFFFFFF + spread) % blocks
                order = np.lexsort((block, core, which))
                at, which, core, block = at[order], which[order], core[order], block[order]
                ends = np.flatnonzero(np.r_[(which[1:] != which[:-1]) | (core[1:] != core[:-1]) | (block[1:] != block[:-1]), np.ones(min(1, len(at)), bool)]) + 1
                for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                    w = which[lo]
                    own, others = (hot_cores[w], hot_tails[w])[::1 if core[lo] else -1]
                    made = row(0, 0, at[lo:hi])
                    tasks = _dealt(bool(core[lo]), int(own), int(others), int(block[lo]))
                    for i in range(0, len(tasks), 256):
                        yield batch_of([(int(hot_buckets[w]) + task, side, *made[2:]) for task, side in tasks[i:i + 256]])

    def batch_of(rows):
        kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "side", "chunk", "word", "line", "size", "place", "bitmap", "wide"])
    return work


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    at = parent[nodes]
    while True:
        above = parent[at]
        if np.array_equal(above, at):
            return at
        at = above


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = _roots(parent, a), _roots(parent, b)
        parent[a], parent[b] = ra, rb
        apart = ra != rb
        a, b = ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _candidates(t: float):
    """Links of the lines of a bucket that share a prefix word and pass all filters, as a star per family."""
    def work(key: tuple, asked: pa.Table) -> pa.Table:
        parts = {c: [unpack(v) for v in asked.column(c).to_pylist()] for c in ("word", "line", "size", "place", "bitmap", "wide")}
        line = np.concatenate([l.astype(np.int64) + (c << PLACES) for l, c in zip(parts["line"], asked.column("chunk").to_pylist())])
        side = np.repeat(asked.column("side").to_numpy(), [len(l) for l in parts["line"]])
        word, size, place = (np.concatenate([v.astype(k) for v in parts[c]]) for c, k in (
            ("word", np.uint64), ("size", np.int64), ("place", np.int64)))
        bitmaps = np.zeros((len(line), 4), np.uint64)
        bitmaps[:, 0] = np.concatenate(parts["bitmap"])
        bitmaps[size > WIDE, 1:] = np.concatenate(parts["wide"]).reshape(-1, 3)
        folded = _folded(bitmaps)
        # By word, then size, then as many bits of the bitmap as a number has room for beside these.
        order = np.argsort(word)
        group = np.cumsum(np.r_[False, word[order][1:] != word[order][:-1]]).astype(np.uint64)
        sizes = int(size.max()).bit_length()
        room = 64 - int(group[-1]).bit_length() - sizes
        some = folded[order] >> np.uint64(64 - room)
        key = (group << np.uint64(sizes) | size[order].astype(np.uint64)) << np.uint64(room) | some
        at = np.argsort(key)
        order, some = order[at], some[at]
        line, side, word, size, place, bitmaps, folded = line[order], side[order], word[order], size[order], place[order], bitmaps[order], folded[order]
        names, node = np.unique(line, return_inverse=True)
        parent = np.arange(len(names))
        # Lines of a word stand together from the shortest on: each meets the next, the next but one, and
        # so on, as far as lines of its word are not too long for it.
        group = np.cumsum(np.r_[False, word[1:] != word[:-1]]) << 32
        last = np.searchsorted(group + size, group + np.floor(size / t + 1e-9).astype(np.int64), "right")
        total = np.arange(2 * int(size.max()) + 1)
        least_of = _overlap(total, 0, t)
        spare_of = (total - 2 * least_of).astype(np.int32)
        # Sets that only an equal one can match meet those of equal bits, which stand together.
        same = np.flatnonzero(np.r_[(word[1:] != word[:-1]) | (size[1:] != size[:-1]) | (some[1:] != some[:-1]), True]) + 1
        alone = (np.floor(size / t + 1e-9) == size) & (spare_of[2 * size] == 0)
        last[alone] = same[np.searchsorted(same, np.flatnonzero(alone), "right")]
        a, step, root = np.flatnonzero(last - np.arange(len(line)) > 1), 1, node
        while len(a):
            b = a + step
            near = np.flatnonzero(np.bitwise_count(folded[a] ^ folded[b]) <= spare_of[size[a] + size[b]])
            x, y = a[near], b[near]
            both = size[x] + size[y]
            # A pair is found at its first shared word, before which nothing is shared.
            most = np.minimum(size[x] - place[x], size[y] - place[y])
            passed = (root[x] != root[y]) & (most >= least_of[both]) & ((side[x] != side[y]) | (side[x] == 0))
            wide = np.flatnonzero(passed & (size[x] > WIDE) & (size[y] > WIDE))
            passed[wide[_differing(bitmaps, x[wide], y[wide]) > spare_of[both[wide]]]] = False
            _unite(parent, node[x[passed]], node[y[passed]])
            step += 1
            a = a[a + step < last[a]]
            if step & (step - 1) == 0:
                # Of lines whose whole range is linked to them already, nothing is left to find.
                parent = _roots(parent, np.arange(len(names)))
                root = parent[node]
                runs = np.flatnonzero(np.r_[(root[1:] != root[:-1]), True]) + 1
                a = a[runs[np.searchsorted(runs, a, "right")] < last[a]]
        root = _roots(parent, np.arange(len(names)))
        linked = root != np.arange(len(names))
        return pa.table({"a": names[linked], "b": names[root[linked]]})
    return work


def _met(chunks: DataFrame, parts: DataFrame) -> DataFrame:
    """Chunk rows, each followed by the rows of ``parts`` with its number, in one task."""
    extra = [f for f in parts.schema.fields if f.name != "chunk"]
    body = chunks.select("chunk", F.lit(0).alias("turn"), "body", "twins", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra])
    rows = parts.select("chunk", F.lit(1).alias("turn"), F.lit(None).cast("binary").alias("body"), F.lit(None).cast("binary").alias("twins"), *[f.name for f in extra])
    return body.union(rows).repartition(partitions(chunks.sparkSession), "chunk").sortWithinPartitions("chunk", "turn")


def _sets(least: int):
    """The words of the lines asked for, with the line's order."""
    def settle(chunk, body, places, families):
        table = _unpack_batch(body)
        order = np.argsort(places)
        places, families = np.array(places)[order], np.array(families)[order]
        lines = _Lines(_texts(table), least, places)
        word, start, size, kept = lines.sets()
        at = np.searchsorted(places, lines.line[kept])
        ids = _order(table)[lines.doc[kept]]
        words = [lines.hashes[word[s:s + n]].tobytes() for s, n in zip(start.tolist(), size.tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array(families[at]), pa.array(ids), pa.array(lines.line[kept] + (chunk << PLACES)), pa.array(words, pa.binary())],
            ["family", "id", "line", "words"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = body = None
        places, families = [], []
        for batch in batches:
            for number, turn, own, place, family in zip(*(batch.column(c).to_pylist() for c in ("chunk", "turn", "body", "place", "family"))):
                if turn == 0:
                    if places:
                        yield settle(chunk, body, places, families)
                    chunk, body, places, families = number, own, [], []
                else:
                    places += place
                    families += family
        if places:
            yield settle(chunk, body, places, families)
    return work


def _jaccard(a: np.ndarray, b: np.ndarray, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Similarity of the sets a[i] and b[i]."""
    out = np.zeros(len(a))
    for at in range(0, len(a), 20_000):
        who = np.stack([a[at:at + 20_000], b[at:at + 20_000]], 1).ravel()
        pair = np.repeat(np.arange(len(who)) // 2, size[who])
        n = size[who]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[who], n)
        value = words[place]
        order = np.lexsort((value, pair))
        value, pair = value[order], pair[order]
        same = (value[1:] == value[:-1]) & (pair[1:] == pair[:-1])
        common = np.bincount(pair[1:][same], minlength=len(who) // 2)
        out[at:at + 20_000] = common / (n.reshape(-1, 2).sum(1) - common)
    return out


def _verified(t: float):
    """Lines that match an earlier line. Rows come by group in order; ``later`` and ``earlier`` say
    on which sides of a comparison a line stands."""
    def settle(group, line, later, earlier, words):
        data = np.frombuffer(b"".join(words), np.uint64)
        size = np.fromiter((len(w) // 8 for w in words), np.int64, len(words))
        start = np.cumsum(size) - size
        mixed = data * np.uint64(0x9E3779B97F4A7C15)
        whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), start)
        bitmaps = _bitmaps(data, start)
        folded = _folded(bitmaps)
        n = len(line)
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        first = np.repeat(head, np.diff(np.r_[head, n]))  # each row's first comparison: the group's first row
        waiting = np.flatnonzero(later)
        removed, step = np.zeros(n, bool), 0
        while True:
            waiting = waiting[first[waiting] + step < waiting]
            if not len(waiting):
                break
            other = first[waiting] + step
            a, b = size[waiting], size[other]
            least = _overlap(a, b, t)
            close = earlier[other] & (np.bitwise_count(folded[waiting] ^ folded[other]) <= a + b - 2 * least)
            match = close & (whole[waiting] == whole[other]) & (a == b)
            check = np.flatnonzero(close & ~match)
            check = check[_differing(bitmaps, waiting[check], other[check]) <= (a + b - 2 * least)[check]]
            match[check] = _jaccard(waiting[check], other[check], data, start, size) >= t - 1e-9
            removed[waiting[match]] = True
            waiting = waiting[~match]
            step += 1
        return pa.RecordBatch.from_arrays([pa.array(line[removed])], ["line"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                group = table.column("grouping").to_numpy()
                cut = len(group) - int((group[::-1] != group[-1]).argmax()) if group[0] != group[-1] else 0
                if cut:
                    yield settle(*columns(table.slice(0, cut)))
                rest = table.slice(cut)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield settle(*columns(pa.Table.from_batches(held)))

    def columns(table):
        table = table.combine_chunks()
        return (*(table.column(c).to_numpy() for c in ("grouping", "line", "later", "earlier")), table.column("words").to_pylist())
    return work


def _rewritten(names: list[str]):
    def settle(body, twins, places):
        table = _unpack_batch(body)
        gone = np.union1d(unpack(twins).astype(np.int64), np.array(places, np.int64))
        column = _texts(table)
        counts = pc.fill_null(pc.add(pc.count_substring(column, "\n"), 1), 0).to_numpy().astype(np.int64)
        start = np.cumsum(counts) - counts
        doc = np.searchsorted(start, gone, "right") - 1
        cuts = np.searchsorted(doc, np.arange(len(column) + 1))
        kept_texts, removed = column.to_pylist(), [[]] * len(column)
        for i in np.unique(doc).tolist():
            removed[i] = (gone[cuts[i]:cuts[i + 1]] - start[i]).tolist()
            lines, drop = kept_texts[i].split("\n"), set(removed[i])
            kept_texts[i] = "\n".join([line for k, line in enumerate(lines) if k not in drop])
        columns = [pa.array(kept_texts, pa.string()) if n == "text" else table.column(n).combine_chunks() for n in names]
        columns += [pa.array(counts.astype(np.int32)), pa.array(removed, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [*names, "n_lines", "removed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            for turn, body, twins, place in zip(*(batch.column(c).to_pylist() for c in ("turn", "body", "twins", "place"))):
                if turn == 0:
                    if waiting:
                        yield settle(*waiting)
                    waiting = [body, twins, []]
                else:
                    waiting[2] += place
        if waiting:
            yield settle(*waiting)
    return work


def _posted(chunks: DataFrame, t: float, least: int) -> DataFrame:
    """The prefix words of all lines, by the bucket in which they meet."""
    buckets = max(1, -(-(chunks.agg(F.sum("postings")).first()[0] or 0) // BUCKET))
    frequent, most, others = _frequent(chunks)
    work = _postings(frequent, buckets, _hot(chunks, frequent, most, others, buckets, t, least), t, least)
    return chunks.select("chunk", "body", "twins").mapInArrow(work, _POSTINGS)


def dedup(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the lines removed that match an earlier one, and with n_lines and removed.

    ``docs``: (doc_id, text) and any other columns, which are kept; columns named n_lines or removed are
    replaced. Lines are what stands between line feeds. A line with at least ``least_words`` distinct words
    (1: every line that is not blank) goes if an earlier one, of this or another row, whether it stays or not, has a Jaccard similarity of
    ``similarity`` or more to its set of words (A-Z lower-cased, between ASCII white space). Earlier: a
    smaller doc_id, null first; of rows with equal ids the one that comes first in the written table.
    n_lines counts the lines that were there, removed lists the places of those removed, from 0. A null
    text stays null with no lines; a text all of whose lines go becomes empty.
    """
    docs = docs.drop("n_lines", "removed").withColumn("doc_id", F.col("doc_id").cast("long"))
    spark, schema = docs.sparkSession, docs.schema
    chunks = written(docs.mapInArrow(_chunks(similarity, least_words), _CHUNK), "none")
    links = _posted(chunks, similarity, least_words).groupBy("bucket").applyInArrow(_candidates(similarity), "a long, b long")
    families = components(links)

    asked = families.groupBy(F.shiftrightunsigned("node", PLACES).alias("chunk")).agg(
        F.collect_list(F.col("node").bitwiseAND(F.lit((1 << PLACES) - 1))).alias("place"), F.collect_list("component").alias("family"))
    sets = _met(chunks, asked).mapInArrow(_sets(least_words), "family long, id long, line long, words binary")
    # A family of more lines than one task should hold is compared block by block.
    in_order = W.partitionBy("family").orderBy("id", "line")
    sets = sets.withColumn("block", F.floor((F.row_number().over(in_order) - 1) / FAMILY))
    sets = sets.withColumn("last", F.max("block").over(W.partitionBy("family")))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    sets = sets.select(
        F.xxhash64("family", F.greatest("block", "other"), F.least("block", "other")).alias("grouping"), "id", "line", "words",
        (F.col("block") >= F.col("other")).alias("later"), (F.col("block") <= F.col("other")).alias("earlier"))
    sets = sets.repartition(partitions(spark), "grouping").sortWithinPartitions("grouping", "id", "line")
    removed = sets.select("grouping", "line", "later", "earlier", "words").mapInArrow(_verified(similarity), "line long").distinct()
    removed = removed.groupBy(F.shiftrightunsigned("line", PLACES).alias("chunk")).agg(
        F.collect_list(F.col("line").bitwiseAND(F.lit((1 << PLACES) - 1))).alias("place"))
    out = T.StructType([*schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("removed", T.ArrayType(T.IntegerType()))])
    return _met(chunks, removed).mapInArrow(_rewritten(schema.names), out)
