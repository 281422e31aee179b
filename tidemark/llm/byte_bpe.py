"""Byte-level BPE by recursive queries: merges until fixpoint in SQL, one DuckDB per partition.

Texts are cut by the vocabulary's pattern. Each distinct piece becomes rows (word, position, token),
one per byte at first. A recursive query joins neighbours with the merge table and contracts each
word's leftmost pair of least rank, until no pair of any word is in the table. An ordered aggregation
gives the bytes of a sequence of ids.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Places, text_batches, texts

#: Bytes of new words that one query takes, words beyond which and bytes beyond which a task forgets its words.
SLICE, KEPT_WORDS, KEPT_BYTES = 300_000, 1_400_000, 64 << 20
#: Matches of the pattern that a task holds at once as strings.
PIECES = 1 << 19
#: Words of more bytes are contracted at many places at once: one pair a round takes rounds as many as a word
#: has merges over rows as many as it has bytes, 0.1 s for 512 bytes and four times that for twice as many. For
#: short words the windows this needs cost more than they save.
LONG = 512
#: Rows that the rounds of one query over long words may add up to.
LONG_ROWS = 1_500_000

# A word whose pairs are not in the table comes out once more, marked, and goes no further.
_SHORT = """
with recursive step(round, word, pos, next_pos, tok, next_tok, ended) as (
  select 0, word, pos, pos + 1, tok, next_tok, false from start
  union all
  select p.round + 1, p.word, p.pos, case when p.pos = b.at then b.beyond else p.next_pos end,
         case when p.pos = b.at then b.merged else p.tok end,
         case when p.pos = b.at then b.after when p.next_pos = b.at then b.merged else p.next_tok end, b.word is null
  from step p left join (
    select g.word, (c.best >> 40)::integer as merged, ((c.best >> 20) & 1048575)::integer as at,
           g.pos as gone, g.next_pos as beyond, g.next_tok as after
    from (select s.word, min((m.merged::bigint << 40) | (s.pos::bigint << 20) | s.next_pos) as best
          from step s join merges m on m.lft = s.tok and m.rgt = s.next_tok where not s.ended group by s.word) c
    join step g on g.word = c.word and g.pos = (c.best & 1048575)) b on b.word = p.word
  where not p.ended and (b.word is null or p.pos <> b.gone))
select word, pos, tok from step where ended"""

# The same for long words, at many places at once. A merge can only be forestalled by one of lower rank whose
# token then reaches it, and no token is longer than ``reach`` bytes: the pair of least rank within that
# many bytes to either side is contracted now as it would be in its turn. Of pairs of equal rank the leftmost
# is; where no merge of the new token ranks before it, all are, every second one of a row of them.
_LONG = """
with recursive step(round, word, pos, tok) as (
  select 0, word, pos, tok from start
  union all
  select round + 1, word, pos, case when taken then merged else tok end
  from (
    select *, coalesce(lag(taken) over w, false) as gone, bool_or(taken) over (partition by word) as goes_on
    from (
      select *, hit and case when last_of_all then unsafe < head and (place - head) % 2 = 0 else here = least end as taken
      from (
        select *, coalesce(max(case when not hit then place end) over w, 0) as unsafe, max(case when first then place end) over w as head
        from (
          select *, coalesce((here >> 32) = (least >> 32), false) as hit, merged is distinct from lag(merged) over w as first
          from (
            select s.*, m.merged, m.last_of_all, (m.merged::bigint << 32) | s.pos as here,
              min((m.merged::bigint << 32) | s.pos) over (partition by s.word order by s.pos range between $reach preceding and 2 * $reach following) as least
            from (select *, lead(tok) over w as follower, row_number() over w as place from step window w as (partition by word order by pos)) s
            left join merges m on m.lft = s.tok and m.rgt = s.follower)
          window w as (partition by word order by pos))
        window w as (partition by word order by pos)))
    window w as (partition by word order by pos))
  where not gone and goes_on and round < $rounds)
select word, pos, tok, round from step qualify round = max(round) over (partition by word)"""

_DECODE = """
select r.seq, string_agg(v.hex, '' order by r.pos) as hex
from given r join vocabulary v on v.id = r.id group by r.seq order by r.seq"""


@dataclass
class Vocabulary:
    """Ranks of a vocabulary as arrays, and the pattern that cuts texts."""

    tokens: list[bytes]
    ids: np.ndarray
    single: np.ndarray
    merges: pa.Table
    pattern: str
    digest: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """``path``: lines of base64 token and rank; all 256 single bytes must be there."""
        with open(path, "rb") as file:
            lines = file.read()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
        found = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = np.array(found, np.int64).reshape(-1, 3).T
        first_use = np.full(max(ranks.values()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first_use, left, merged)
        np.minimum.at(first_use, right, merged)
        merges = pa.table({
            "lft": pa.array(left, pa.int32()), "rgt": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32()),
            "last_of_all": pa.array(first_use[merged] > merged)})
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        digest = hashlib.sha256(lines + pattern.encode()).hexdigest()
        return cls(list(ranks), np.array(list(ranks.values()), np.int32), single, merges, pattern, digest)


class Coder:
    """A DuckDB in memory with the merge table and the vocabulary; used by one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.single = vocabulary.single
        self.whole = dict(zip(vocabulary.tokens, vocabulary.ids.tolist()))
        self.lengths = np.zeros(int(vocabulary.ids.max()) + 1, np.int64)
        self.lengths[vocabulary.ids] = [len(t) for t in vocabulary.tokens]
        self.by_length: dict[int, set[bytes]] = {}
        for token in vocabulary.tokens:
            self.by_length.setdefault(len(token), set()).add(token)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._table("merges", vocabulary.merges)
        self._table("vocabulary", pa.table({"id": pa.array(vocabulary.ids), "hex": pa.array([t.hex() for t in vocabulary.tokens])}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def _start(self, words: list[tuple[int, bytes]]) -> pa.Table:
        """Rows of the words: a byte each, or one where the whole word is a token."""
        whole = [(i, self.whole[w]) for i, w in words if w in self.whole]
        cut = [(i, w) for i, w in words if w not in self.whole]
        lengths = np.array([len(w) for _, w in cut], np.int64)
        data = np.frombuffer(b"".join(w for _, w in cut), np.uint8)
        word = np.repeat(np.array([i for i, _ in cut], np.int32), lengths)
        place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tok = self.single[data]
        follower = np.r_[tok[1:], [-1]][:len(tok)]
        follower[np.cumsum(lengths) - 1] = -1
        rows = {
            "word": np.r_[word, [i for i, _ in whole]], "pos": np.r_[place, [0] * len(whole)],
            "tok": np.r_[tok, [t for _, t in whole]], "next_tok": np.r_[follower, [-1] * len(whole)]}
        return pa.table({name: column.astype(np.int32) for name, column in rows.items()})

    def _reach(self, word: bytes) -> int:
        """Bytes of the longest token that occurs in a word."""
        for n in sorted(self.by_length, reverse=True):
            if n <= len(word) and not self.by_length[n].isdisjoint({word[i:i + n] for i in range(len(word) - n + 1)}):
                return n
        return 1

    def _settle_long(self, index: int, word: bytes) -> None:
        rows, query = self._start([(index, word)]), _LONG.replace("$reach", str(self._reach(word)))
        while True:
            self._table("start", rows)
            rounds = max(1, LONG_ROWS // rows.num_rows)
            found = self.db.sql(query.replace("$rounds", str(rounds))).to_arrow_table()
            rows = found.select(["word", "pos", "tok"])
            if found.column("round")[0].as_py() < rounds:
                break
        self.db.register("incoming", rows)
        self.db.execute("insert into ended select word, pos, tok from incoming")
        self.db.unregister("incoming")

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each word has."""
        ids, counts, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(words):
            stop, size = at, 0
            while stop < len(words) and (stop == at or size + len(words[stop]) <= SLICE):
                size += len(words[stop])
                stop += 1
            part = list(enumerate(words[at:stop]))
            self._table("start", self._start([(i, w) for i, w in part if len(w) <= LONG]))
            self.db.execute(f"create or replace table ended as {_SHORT}")
            for i, w in part:
                if len(w) > LONG:
                    self._settle_long(i, w)
            found = self.db.sql("select word, tok from ended order by word, pos").to_arrow_table()
            ids.append(found.column("tok").to_numpy().astype(np.int64))
            counts.append(np.bincount(found.column("word").to_numpy(), minlength=len(part)))
            at = stop
        return np.concatenate(ids), np.concatenate(counts)

    def decode(self, sequences: list[list[int]]) -> list[bytes]:
        """The bytes of each sequence of ids; an id that the vocabulary lacks is an error."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        flat = np.array([i for s in sequences for i in s], np.int64)
        unknown = np.setdiff1d(flat, np.fromiter(self.whole.values(), np.int64))
        if len(unknown):
            raise ValueError(f"ids not in the vocabulary: {unknown[:5].tolist()}")
        self._table("given", pa.table({
            "seq": np.repeat(np.arange(len(sequences)), lengths), "pos": np.arange(len(flat)), "id": flat}))
        found = self.db.sql(_DECODE).to_arrow_table()
        out = [b""] * len(sequences)
        for seq, text in zip(found.column("seq").to_pylist(), found.column("hex").to_pylist()):
            out[seq] = bytes.fromhex(text)
        return out

    def decode_words(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of words given by their ids, one after the other: ordered aggregations over runs of
        ``SLICE`` ids, cut where the tokens' lengths say."""
        data = b"".join(self.decode([ids[at:at + SLICE].tolist() for at in range(0, len(ids), SLICE)]))
        ends = np.cumsum(self.lengths[ids])[np.cumsum(counts) - 1].tolist() if len(counts) else []
        return [data[a:b] for a, b in zip([0, *ends], ends)]


class Words:
    """The distinct words that a task has met: their places, and the ids of each."""

    def __init__(self):
        self.places, self.data, self.bytes = Places(), [], 0
        self.ids = self.counts = self.starts = np.zeros(0, np.int64)

    def places_of(self, pieces: list[str]) -> np.ndarray:
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        own = np.fromiter(map(self.places.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        return own[coded.indices.to_numpy()]

    def take_in(self, coder: Coder, decoded: bool) -> None:
        """Encodes the words met since the last time, and with ``decoded`` decodes their ids."""
        fresh = [w.encode("utf-8") for w in islice(self.places, len(self.counts), None)]
        ids, counts = coder.encode(fresh)
        self.ids, self.counts = np.r_[self.ids, ids], np.r_[self.counts, counts]
        self.starts = np.cumsum(self.counts) - self.counts
        self.bytes += sum(map(len, fresh))
        if decoded:
            self.data += coder.decode_words(ids, counts)

    def ids_of(self, places: np.ndarray) -> np.ndarray:
        """The ids of a text from its words' places."""
        counts = self.counts[places]
        return self.ids[np.arange(counts.sum()) + np.repeat(self.starts[places] - np.cumsum(counts) + counts, counts)]


def _kept() -> dict:
    """What a worker process keeps from one task to the next, as Spark gives it many: by vocabulary, the
    merge tables and the words met, within the bounds of a task."""
    return sys.modules.setdefault("tidemark_kept", types.ModuleType("tidemark_kept")).__dict__


def _encoded(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch], decoded: bool = False):
    """Of each batch: itself, the words of each text as places, and the task's words."""
    pattern, key = regex.compile(vocabulary.pattern), (vocabulary.digest, decoded)
    # taken out while in use: what a task leaves behind when it breaks off is not used again
    coder, words = _kept().pop(key, None) or (Coder(vocabulary), Words())
    for batch in text_batches(batches, 4 << 20):
        found, held, counts = [np.zeros(0, np.int64)], [], []
        for text in texts(batch):
            matches, n = pattern.finditer(text) if len(text) > 1 << 20 else None, 0
            while piece := [m.group() for m in islice(matches, PIECES)] if matches else pattern.findall(text):
                held += piece
                n += len(piece)
                if len(held) > PIECES:
                    found.append(words.places_of(held))
                    held = []
                if not matches:
                    break
            counts.append(n)
        found.append(words.places_of(held))
        words.take_in(coder, decoded)
        yield batch, np.split(np.concatenate(found), np.cumsum(counts)[:-1]), words
        if len(words.counts) > KEPT_WORDS or words.bytes > KEPT_BYTES:
            words = Words()
    _kept()[key] = coder, words


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids array<int>) of each whole text, without special tokens; null or empty: no ids."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, docs, words in _encoded(vocabulary, batches):
            ids = [words.ids_of(doc).tolist() for doc in docs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, data binary) of rows (doc_id, ids): the bytes of the ids in order; null or no ids: empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                data = coder.decode([s or [] for s in part.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(work, "doc_id long, data binary")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids, as decimals joined
    by spaces, and of the bytes they decode to, without the ids leaving their task.

    A text's ids are those of its words in order. The decoder gets the ids of each distinct word, and a
    text's bytes are its words' decoded ones in order. A null text counts as empty.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decimal = list(map(str, range(int(vocabulary.ids.max()) + 1)))
        for batch, docs, words in _encoded(vocabulary, batches, decoded=True):
            out = []
            for doc in docs:
                ids, data = words.ids_of(doc).tolist(), b"".join(map(words.data.__getitem__, doc.tolist()))
                out.append((len(ids), hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
