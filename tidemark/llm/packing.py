"""Best-fit packing with conflicts: texts of one source or one group of copies never share a bin.

Rows are dealt to shards of bounded size by hash. In a shard, longest first, each text goes to the bin
that it leaves fullest among those compatible with it. Bins stand in order of their free room and carry
a bitmap of their sources and one of their copy groups; the search starts at the least room that fits
and goes on to the next larger until neither bitmap has the text's bit.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Room of a bin in units of ``size`` (characters by default), and pieces of a shard.
CAPACITY, SHARD = 8_192, 4_096

_OUT = "doc_id long, piece int, size long, bin long, start long"


class Shard:
    """Bins of one shard. Sources and copy groups that occur once can conflict with nothing and get no bit.

    Bins of equal room and equal bitmaps take the same texts, so they stand together in one list, oldest
    first, and a search looks at each such kind once.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.kinds: dict[tuple[int, int, int], list[int]] = defaultdict(list)  # (room, sources, groups): bins
        self.rooms: list[int] = []  # ascending, each once
        self.by_room: dict[int, list[tuple[int, int]]] = {}
        self.bins = 0

    def _remove(self, kind: tuple[int, int, int]) -> int:
        number = self.kinds[kind].pop(0)
        if not self.kinds[kind]:
            del self.kinds[kind]
            self.by_room[kind[0]].remove(kind[1:])
            if not self.by_room[kind[0]]:
                del self.by_room[kind[0]]
                self.rooms.pop(bisect_left(self.rooms, kind[0]))
        return number

    def _insert(self, kind: tuple[int, int, int], number: int) -> None:
        if kind[0] not in self.by_room:
            self.by_room[kind[0]] = []
            insort(self.rooms, kind[0])
        if kind not in self.kinds:
            self.by_room[kind[0]].append(kind[1:])
        insort(self.kinds[kind], number)

    def place(self, size: int, source: int, group: int) -> tuple[int, int]:
        """(bin, start) of a piece; ``source`` and ``group`` are bits or 0. Of equal bins the oldest takes it."""
        for at in range(bisect_left(self.rooms, size), len(self.rooms)):
            room = self.rooms[at]
            fitting = [(self.kinds[room, s, g][0], s, g) for s, g in self.by_room[room] if not s & source and not g & group]
            if fitting:
                number, s, g = min(fitting)
                self._remove((room, s, g))
                self._insert((room - size, s | source, g | group), number)
                return number, self.capacity - room
        number = self.bins
        self.bins += 1
        self._insert((self.capacity - size, source, group), number)
        return number, 0


def pack(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each (size, source, group), longest first, ties as given; a null never conflicts."""
    sources = Counter(s for _, s, _ in pieces if s is not None)
    groups = Counter(g for _, _, g in pieces if g is not None)
    source_bit = {s: 1 << i for i, s in enumerate(s for s, n in sources.items() if n > 1)}
    group_bit = {g: 1 << i for i, g in enumerate(g for g, n in groups.items() if n > 1)}
    shard, out = Shard(capacity), [(0, 0)] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][0]):
        size, source, group = pieces[i]
        out[i] = shard.place(size, source_bit.get(source, 0), group_bit.get(group, 0))
    return out


def _packed(capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "size", "source", "cluster")))
            for shard, *row in rows:
                if shard != at and held:
                    yield settle(at, held)
                    held = []
                at = shard
                held.append(row)
        if held:
            yield settle(at, held)

    def settle(shard: int, rows: list) -> pa.RecordBatch:
        pieces = []  # (doc_id, piece, size, source, cluster); full pieces of long texts fill a bin each
        for doc_id, size, source, cluster in rows:
            full = size // capacity
            pieces += [(doc_id, i, capacity, source, cluster) for i in range(full)]
            if size % capacity or not full:
                pieces.append((doc_id, full, size - full * capacity, source, cluster))
        found = pack([p[2:] for p in pieces], capacity)
        ids, number, sizes = (list(c) for c in zip(*(p[:3] for p in pieces)))
        bins = np.array([b for b, _ in found], np.int64) + (np.int64(shard) << 32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(sizes, pa.int64()), pa.array(bins), pa.array([s for _, s in found], pa.int64())],
            ["doc_id", "piece", "size", "bin", "start"])
    return work


def copy_group(text: Column) -> Column:
    """Equal for texts with the same words, A-Z lower-cased, whatever their white space; null for null."""
    return F.xxhash64(F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " ")))


def best_fit(docs: DataFrame, capacity: int = CAPACITY, size: Column | None = None, cluster: Column | None = None,
             pieces: int = SHARD) -> DataFrame:
    """(doc_id, piece, size, bin, start): where each piece of each row of ``docs`` lies.

    ``docs``: (doc_id, text, source). ``size`` is a row's length (code points of the text by default; null
    or negative counts as 0), ``cluster`` its group of copies (equal words by default). A longer text than
    ``capacity`` is cut into pieces that fill a bin each, and a rest. No bin holds two rows of a source, nor
    two of a cluster; a null source or a null text conflicts with nothing. Rows of size 0 are placed too.

    Shards get about ``pieces`` rows each by a hash of the row and its place in the input, so a hot source or
    group spreads evenly over all, and so do repeated rows and rows without id and text. Within one, rows
    are taken longest first, then by doc_id, null first.
    """
    size = F.length("text") if size is None else size
    cluster = copy_group(F.col("text")) if cluster is None else cluster
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"),
        F.col("source").cast("string").alias("source"), F.when(F.col("text").isNotNull(), cluster.cast("long")).alias("cluster"))
    count = docs.count()
    shards = max(1, -(-count // pieces))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.desc("size"), "doc_id", "source", "cluster")
    return rows.mapInArrow(_packed(capacity), _OUT)
