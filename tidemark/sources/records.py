"""CSV records whose quoted fields hold line breaks, read in splits.

A line break ends a record unless it stands inside quotes, and whether it does depends on all lines
before it. Each line maps the state before it (outside or inside quotes) to the state after it, so
a split of a file is the composition of its lines' maps: one map over the splits finds these, and
composing them along a file gives the state in which each split begins. With that every task cuts its
splits into records by itself. Only a record that crosses a border between splits is put together by a
shuffle, of that record's pieces alone.

Quotes follow the usual rules: a quote opens a field only at its start, doubled quotes stand for one,
and other characters after a closing quote belong to the field.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Functions that run in tasks travel with the plan: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# States within a line, while its quotes are gone through.
_FIELD_START, _IN_FIELD, _QUOTED, _AFTER_QUOTE = range(4)
_BOM = "\ufeff"


def ends_quoted(line: Column, begins_quoted: bool) -> Column:
    """Whether the end of a line stands inside quotes, given how the line begins."""
    def at_quote(state: Column, text: Column) -> Column:
        opens = F.endswith(text, F.lit(","))
        outside = F.when(opens, _QUOTED).otherwise(_IN_FIELD)
        return (F.when(state == _QUOTED, _AFTER_QUOTE)
                .when(text != "", outside)
                # nothing since a quote that closed: the two are one of the field's characters
                .when(state == _IN_FIELD, _IN_FIELD).otherwise(_QUOTED))

    first = _QUOTED if begins_quoted else _FIELD_START
    parts = F.split(line, '"', -1)
    before_last = F.slice(parts, 1, F.size(parts) - 1)
    # every part but the last is followed by a quote
    walked = F.aggregate(before_last, F.lit(first), at_quote)
    return F.when(F.contains(line, F.lit('"')), walked == _QUOTED).otherwise(F.lit(begins_quoted))


def without_mark(line: Column) -> Column:
    """A line without the byte order mark that a file may begin with."""
    return F.when(F.startswith(line, F.lit(_BOM)), F.substring(line, 2, 1 << 30)).otherwise(line)


def lines_of(spark: SparkSession, paths: list[str], path: Column) -> DataFrame:
    """Lines in the order of each split: ``path``, ``block`` (where its split begins), ``line``, and the
    state after it from outside (``from_out``) and from inside quotes (``from_in``).

    A line keeps the carriage return before its end, which inside quotes is part of the text.
    """
    text = (spark.read.option("lineSep", "\n").text(paths)
            .select(path.alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").alias("line")))
    return text.withColumn("line", F.when(F.col("block") == 0, without_mark(F.col("line"))).otherwise(F.col("line"))).withColumns(
        {"from_out": ends_quoted(F.col("line"), False), "from_in": ends_quoted(F.col("line"), True)})


class _Split:
    """Runs over a split's lines batch by batch; ``state`` is whether the next line begins inside quotes."""

    def __init__(self, state: bool):
        self.state = state

    def before(self, from_out: np.ndarray, from_in: np.ndarray) -> np.ndarray:
        """The state before each line of the next batch.

        After the last line that ends alike from either state, the state changes with each line that swaps.
        """
        n = len(from_out)
        swaps = np.cumsum(from_out & ~from_in)
        settled = np.maximum.accumulate(np.where(from_out == from_in, np.arange(n), -1))
        known = settled >= 0
        at = np.where(known, settled, 0)
        start = np.where(known, from_out[at], self.state)
        after = start ^ ((swaps - np.where(known, swaps[at], 0)) % 2 == 1)
        before = np.r_[np.bool_(self.state), after[:-1]]
        self.state = bool(after[-1])
        return before


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, pa.RecordBatch | None]]:
    """(path, block, is new, lines): a split's lines in order; None after its last."""
    at = None
    for batch in batches:
        block, path = batch.column("block").to_numpy(), batch.column("path").dictionary_encode()
        number = path.indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (number[1:] != number[:-1]), True])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            key = (path.dictionary[int(number[lo])].as_py(), int(block[lo]))
            if at is not None and at != key:
                yield *at, False, None
            yield *key, at != key, batch.slice(lo, hi - lo)
            at = key
    if at is not None:
        yield *at, False, None


def _flags(lines: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(lines.column(c).to_numpy(zero_copy_only=False) for c in ("from_out", "from_in"))


def _split_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its path, block, and the state after it from outside and from inside quotes."""
    for path, block, new, lines in _splits(batches):
        if new:
            runs = _Split(False), _Split(True)
        if lines is not None:
            for run in runs:
                run.before(*_flags(lines))
        else:
            yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "from_out": [runs[0].state], "from_in": [runs[1].state]})


def inside_splits(lines: DataFrame) -> DataFrame:
    """(path, block) of the splits that begin inside quotes.

    Maps are composed along a file as they are within a split: from the last split that ends alike from
    either state on, every split that swaps changes the state.
    """
    maps = lines.select("path", "block", "from_out", "from_in").mapInArrow(
        _split_maps, "path string, block long, from_out boolean, from_in boolean")
    along = Window.partitionBy("path").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("from_out") & ~F.col("from_in")).cast("int")
    settled = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").cast("int").alias("state"), "swaps"))
    maps = maps.withColumn("swaps", F.sum(swap).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(settled, ignorenulls=True).over(earlier)
    since = F.coalesce(F.max("swaps").over(earlier), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    begins = F.coalesce(last["state"], F.lit(0)) + since
    return maps.withColumn("begins", begins % 2 == 1).where("begins").select("path", "block")


# What a row of text is: a whole record, or the first, a middle or the last piece of one that crosses splits.
WHOLE, FIRST, MIDDLE, LAST = range(4)
_PIECES = pa.schema([("path", pa.string()), ("block", pa.int64()), ("piece", pa.int32()), ("record", pa.string())])


def _rows(path: str, block: int, piece: int, records: pa.Array | list[str]) -> pa.RecordBatch:
    n = len(records)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([piece] * n, pa.int32()), pa.array(records, pa.string())],
        schema=_PIECES)


def _cut(borders: bool):
    """Records that lie in one split, or (``borders``) the pieces of those that do not. Headers stay out."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, block, new, lines in _splits(batches):
            if new:
                inside = bool(lines.column("inside")[0].as_py())
                run, held, kind, header = _Split(inside), [], LAST if inside else WHOLE, block == 0
            if lines is None:
                if run.state and borders:  # goes on in the next split
                    yield _rows(path, block, MIDDLE if kind == LAST else FIRST, ["\n".join(held)])
                continue
            text, open_before = lines.column("line"), run.state
            begins = np.flatnonzero(~run.before(*_flags(lines)))
            if open_before:
                held += text.slice(0, int(begins[0]) if len(begins) else len(text)).to_pylist()
                if len(begins) or not run.state:
                    if not header and (kind == LAST) == borders:
                        yield _rows(path, block, kind, ["\n".join(held)])
                    held, kind, header = [], WHOLE, False
            if not len(begins):
                continue
            stops = np.r_[begins[1:], len(text)]
            if run.state:
                held = text.slice(int(begins[-1])).to_pylist()
                begins, stops = begins[:-1], stops[:-1]
            if header and len(begins):
                begins, stops, header = begins[1:], stops[1:], False
            if borders or not len(begins):
                continue
            single = stops - begins == 1
            yield _rows(path, block, WHOLE, text.take(pa.array(begins[single])))
            if not single.all():
                several = zip(begins[~single].tolist(), stops[~single].tolist())
                yield _rows(path, block, WHOLE, ["\n".join(text.slice(b, s - b).to_pylist()) for b, s in several])
    return work


def _first_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, block, new, lines in _splits(batches):
        if new:
            run, held, done = _Split(False), [], False
        if lines is None or done:
            continue
        begins = np.flatnonzero(~run.before(*_flags(lines)))
        begins = begins[begins > 0] if not held else begins
        stop = int(begins[0]) if len(begins) else len(lines)
        held += lines.column("line").slice(0, stop).to_pylist()
        if len(begins) or not run.state:
            done = True
            yield _rows(path, block, WHOLE, ["\n".join(held)])


def headers(lines: DataFrame) -> DataFrame:
    """(path, header): the first record of each file, as far as it lies in the file's first split."""
    first = lines.where(F.col("block") == 0).select("path", "block", "line", "from_out", "from_in")
    return first.mapInArrow(_first_record, "path string, block long, piece int, record string").select("path", F.col("record").alias("header"))


def records_of(lines: DataFrame) -> DataFrame:
    """(path, record): the text of every record but the headers and blank ones.

    The splits that begin inside quotes are broadcast, a path and a number each: at most one for every
    ``spark.sql.files.maxPartitionBytes`` of the files, so some thousands for a terabyte. Their order within
    a task is the scan's. A quote that is never closed is an error.
    """
    inside = F.broadcast(inside_splits(lines).withColumn("inside", F.lit(True)))
    marked = lines.join(inside, ["path", "block"], "left").select(
        "path", "block", "line", "from_out", "from_in", F.coalesce("inside", F.lit(False)).alias("inside"))
    schema = "path string, block long, piece int, record string"
    whole = marked.mapInArrow(_cut(borders=False), schema).select("path", "record")
    pieces = marked.mapInArrow(_cut(borders=True), schema)
    along = Window.partitionBy("path").orderBy("block", F.col("piece") == FIRST)
    pieces = pieces.withColumn("number", F.count_if(F.col("piece") == FIRST).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = pieces.groupBy("path", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("pieces"), F.max("piece").alias("last"))
    closed = F.assert_true(F.col("last") == LAST, F.concat(F.col("path"), F.lit(": a quote is never closed"))).isNull()
    crossing = joined.where(closed).select("path", F.array_join(F.col("pieces.record"), "\n").alias("record"))
    record = F.regexp_replace("record", "\r$", "")
    return whole.union(crossing).select("path", record.alias("record")).where(F.trim("record") != "")
