"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

Two fingerprints that differ in at most ``radius`` bits agree in at least ``blocks - radius`` of
``blocks`` equal bit blocks. Each distinct fingerprint goes to one shard per choice of that many
blocks, so every link lies whole in a shard. In each shard a BK-tree is built: a child's key is its
integer Hamming distance to its parent, and a search follows only the edges within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, partitions, text_batches, texts, written

SEED = 42
BLOCKS = 4
#: Members of a shard beyond which its key takes in further bits.
SHARD = 20_000
#: Rows that a task holds at once, and queries that are searched at once.
ROWS, QUERIES = 400_000, 20_000


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority bits over the XXH64 of all word shingles (A-Z lower-cased, ASCII white space splits)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[k - 1:].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns, all long, and simhash: each row's whole text's fingerprint as a signed number."""
    names = list(carried)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            values = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values)], [*names, "simhash"])

    rows = docs.select(*[F.col(n).cast("long") for n in names], "text")
    return rows.mapInArrow(work, ", ".join(f"`{n}` long" for n in [*names, "simhash"]))


class BKForest:
    """A BK-tree for each run of equal ``shard`` values; nodes are kept in arrays, level by level."""

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        """``shard`` must be sorted."""
        n = len(values)
        self.values = values
        self.root = np.zeros(n, np.int64)  # of each member: the node its shard starts at
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root[:] = np.repeat(first, np.diff(np.r_[first, n]))
        keys, nodes = [], []
        parent, item = self.root.copy(), np.arange(n)
        left = parent != item
        parent, item = parent[left], item[left]
        while len(item):
            # All that hang below a parent at one distance: the first becomes its child, the rest go below it.
            key = parent * 65 + np.bitwise_count(values[parent] ^ values[item])
            order = np.argsort(key, kind="stable")
            key, item = key[order], item[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            child = np.repeat(item[heads], np.diff(np.r_[heads, len(key)]))
            keys.append(key[heads])
            nodes.append(item[heads])
            left = child != item
            parent, item = child[left], item[left]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        nodes = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.nodes = keys[order], nodes[order]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(member, other member) within the radius in its shard's tree, for slices of the members."""
        for at in range(0, len(self.values), QUERIES):
            query = np.arange(at, min(at + QUERIES, len(self.values)))
            node = self.root[query]
            while len(query):
                distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                hit = (distance <= radius) & (node != query)
                yield query[hit], node[hit]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0), "left")
                high = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), "right")
                count = high - low
                offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                query, node = np.repeat(query, count), self.nodes[np.repeat(low, count) + offset]


def lowest_labels(n: int, pairs: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray) -> np.ndarray:
    """The smallest name in each member's component of the links ``pairs``."""
    label = names.copy()
    a = np.concatenate([p[0] for p in pairs] or [np.zeros(0, np.int64)])
    b = np.concatenate([p[1] for p in pairs] or [np.zeros(0, np.int64)])
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if np.array_equal(before, label):
            break
    return label


def _edges(radius: int):
    def settle(shard, values, names):
        order = np.lexsort((values, shard))
        shard, values, names = shard[order], values[order], names[order]
        forest = BKForest(shard, values.view(np.uint64))
        label = lowest_labels(len(values), list(forest.links(radius)), names)
        linked = label != names
        return pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(label[linked])], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((0,), np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if len(held[0]) >= ROWS:  # shards arrive in order: the last one may go on
                cut = int(np.searchsorted(held[0], held[0][-1], "left"))
                if cut:
                    yield settle(*(h[:cut] for h in held))
                    held = [h[cut:] for h in held]
        if len(held[0]):
            yield settle(*held)
    return work


def near_links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints within ``radius`` bits.

    ``nodes``: (simhash, node), one row per distinct fingerprint. Within a shard a member gets one edge,
    to the smallest node it reaches there, so edges grow with members, not pairs. A shard has at least 32
    bits of its members in common; one of over ``SHARD`` members is dealt out by further bits, a third
    of the rest plus its place, of which the members of a link must share one: the largest possible
    shard then has 2 to the 22 members.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius 0 to 2")
    width = 64 // BLOCKS

    def bits(at: int, n: int):
        return F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit((1 << n) - 1))

    choices = list(combinations(range(BLOCKS), BLOCKS - 2))
    keys, finer = [], []
    for i, (p, q) in enumerate(choices):
        keys.append((F.lit(i) * (1 << 32) + bits(p * width, width) * (1 << width) + bits(q * width, width)))
        r, s = (x for x in range(BLOCKS) if x not in (p, q))
        rest = bits(r * width, width) * (1 << width) + bits(s * width, width)
        thirds = [(0, 11), (11, 11), (22, 10)]
        finer.append(F.array(*[F.lit(1 + j) * (1 << 11) + F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << n) - 1)) for j, (at, n) in enumerate(thirds)]))
    rows = nodes.select("simhash", "node", F.explode(F.arrays_zip(F.array(*keys).alias("shard"), F.array(*finer).alias("finer"))).alias("k"))
    rows = rows.select("simhash", "node", F.col("k.shard").alias("shard"), F.col("k.finer").alias("finer"))
    counts = rows.groupBy("shard").count().filter("count > 1")
    rows = rows.join(counts, "shard")
    rows = rows.withColumn("part", F.explode(F.when(F.col("count") > SHARD, F.col("finer")).otherwise(F.array(F.lit(0).cast("long")))))
    rows = rows.select((F.col("shard") * (1 << 14) + F.col("part")).alias("shard"), "simhash", "node")
    rows = rows.repartition(partitions(nodes.sparkSession), "shard").sortWithinPartitions("shard")
    return rows.mapInArrow(_edges(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, simhash, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reached by links of at most ``radius`` differing bits, the
    row's own included. Null and blank texts have fingerprint zero and link like any other. Repeated
    rows are returned as often as given. A null doc_id takes part, but never names a component: it
    is null only where no linked row has an id.

    Fingerprints are computed once and written (16 bytes a row). Equal ones are merged by a partial
    aggregation before anything is compared, so copies cost one row per task.
    """
    marked = written(fingerprints(docs, shingle))
    return marked.join(_least(marked, "doc_id", radius), "simhash", "left").select("doc_id", "simhash", F.col("least").alias("component_id"))


def _least(marked: DataFrame, value: str, radius: int) -> DataFrame:
    """(simhash, least): the least ``value`` in the component of each fingerprint. Fingerprints are the nodes,
    so that rows without an id link like any other."""
    nodes = written(marked.groupBy("simhash").agg(F.min(value).alias("own")))
    groups = components(near_links(nodes.select("simhash", F.col("simhash").alias("node")), radius))
    linked = nodes.join(groups.withColumnRenamed("node", "simhash"), "simhash")
    least = linked.groupBy("component").agg(F.min("own").alias("least"))
    named = linked.select("simhash", "component").join(least, "component").select("simhash", "least")
    return nodes.join(named, "simhash", "left").select("simhash", F.coalesce("least", "own").alias("least"))


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each component of ``docs``: that of the smallest doc_id, of those the least text hash.

    Rows are judged by id and text, so rows that share an id, or have none, stay or go each for itself.
    A row without an id stays only where no linked row has one. Copies of one id and text are looked
    for first; only where there are some are the kept texts shuffled to find equal ones.
    """
    names = ["id", "hash", "check"]
    id_, hash_, check = docs.doc_id.cast("long"), F.xxhash64(docs.text), F.coalesce(F.crc32(docs.text.cast("binary")), F.lit(-1))
    marked = written(fingerprints(docs.select(docs.text, id_.alias("id"), hash_.alias("hash"), check.alias("check")), shingle, names))
    ranked = marked.withColumn("rank", F.struct(F.col("id").isNull().alias("none"), *names))
    found = marked.join(_least(ranked, "rank", radius), "simhash")
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("hash") == F.col("least.hash")) & (F.col("check") == F.col("least.check"))
    gone = found.filter(~first).select(*names).distinct()
    # merged at every size: the rows that go have no bound for a broadcast
    kept = docs.join(gone.hint("merge"), id_.eqNullSafe(gone.id) & (hash_ == gone.hash) & (check == gone.check), "left_anti")
    repeats = marked.groupBy(*names).count().filter("count > 1")
    return kept if repeats.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
