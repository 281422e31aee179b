"""Ingest of region/month CSV files (``<root>/**/<region>/<YYYY-MM>.csv``).

Files are taken in batches of bounded size; of a batch the driver handles the names and the
few distinct header lines.  Headers are found by one distributed pass and rows are read in
splits by the tasks, so neither many files nor one very large file is a job of its own.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import whole_number
from tidemark.rules import HEADER_TO_COLUMN, MISSING_TEXTS
from tidemark.schema import LONG_COLUMNS, RAW_PARTITIONS, RAW_SCHEMA
from tidemark.sources import records
from tidemark.sources.raw_table import busy_columns, enter, open_ledger, read_ledger, table_buckets, write_rows

_BROKEN = "broken_line"
# Files that are loaded and entered in the ledger together.
FILES_PER_BATCH = 10_000


# --- names: what a file path says about its rows -------------------------------------------

def region_of(path: Column) -> Column:
    return F.upper(F.element_at(F.split(path, "/"), -2))


def month_of(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("-01"))


def source_file_of(path: Column) -> Column:
    return F.concat_ws("/", F.slice(F.split(path, "/"), -2, 2))


def with_lineage(rows: DataFrame, path: Column, load_date: date | None = None) -> DataFrame:
    """Region, month, source file, load date (default: today) and the empty test mark."""
    loaded = F.current_date() if load_date is None else F.lit(load_date)
    return rows.withColumns({
        "region": region_of(path),
        "snapshot_month": month_of(path),
        "source_file": source_file_of(path),
        "load_date": loaded.cast("string"),
        "is_test": F.lit(None).cast("int"),
    })


# --- files: discovery, and which of them are new -------------------------------------------

def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all CSV files below ``root`` with their region and month, hidden folders included."""
    found = (spark.read.format("binaryFile")  # only the path is selected: no content is read
             .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
             .load(root).select("path"))
    within, _ = hidden_files(spark, root)
    if within:
        found = found.union(spark.createDataFrame([(p,) for p in within], "path string"))
    return with_file_keys(found)


def hidden_files(spark: SparkSession, root: str) -> tuple[list[str], list[str]]:
    """CSV files that a listing by Spark passes over: those below folders whose name starts with ``_`` or
    ``.``, and those with such a name themselves.  The former can be read by their path, the latter not.

    Each level below ``root`` is looked through by its hidden names only, down to the last level.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found, above = set(), ""
    while len(system.globStatus(hadoop.Path(base, f"{above}*")) or []):
        for status in system.globStatus(hadoop.Path(base, f"{above}[_.]*")) or []:
            if status.isFile():
                found.add(status.getPath().toString())
                continue
            files = system.listFiles(status.getPath(), True)
            while files.hasNext():
                found.add(files.next().getPath().toString())
        above += "*/"
    found = sorted(p for p in found if p.endswith(".csv"))
    named = [p for p in found if p.rsplit("/", 1)[1][0] in "_."]
    return [p for p in found if p not in set(named)], named


def with_file_keys(paths: DataFrame) -> DataFrame:
    path = F.col("path")
    return paths.select("path", month_of(path).alias("snapshot_month"),
                        region_of(path).alias("region"))


def new_files(files: DataFrame, loaded: DataFrame) -> DataFrame:
    """One file for each (month, region) that ``loaded`` does not hold: the first by path."""
    return (files.join(loaded.select(*RAW_PARTITIONS).distinct(), RAW_PARTITIONS, "left_anti")
            .groupBy(*RAW_PARTITIONS).agg(F.min("path").alias("path")))


def only_new(batch: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows of a batch whose (month, region) ``loaded`` does not hold."""
    return batch.join(loaded.select(*RAW_PARTITIONS).distinct(), RAW_PARTITIONS, "left_anti")


# --- rows ----------------------------------------------------------------------------------

def scan_files(spark: SparkSession, paths: Iterable[str], multi_line: bool = False) -> DataFrame:
    """All fields of the mapped headers as text, with the ``path`` each row came from.

    Columns go by header name, so files may differ in column order; a file without one of the headers is
    an error. Files are read in splits, also those with line breaks in quotes (``sources.records``);
    ``multi_line=True`` reads each file in one piece instead, which gives the same rows.
    """
    plain, broken = _by_header(spark, list(paths))
    scans = []
    for line, group in plain:
        scans.append(_scan(spark, group, _header(line, group[0]), multi_line))
    if broken and multi_line:
        scans += [_scan(spark, group, _header(line, group[0]), True) for line, group in _grouped(_whole_headers(spark, broken))]
    elif broken:
        scans += _scan_broken(spark, broken)
    if not scans:
        names = [*HEADER_TO_COLUMN.values(), "path"]
        return spark.createDataFrame([], T.StructType(
            [T.StructField(n, T.StringType()) for n in names]))
    return reduce(DataFrame.unionByName, scans)


def _header(line: str, path: str) -> tuple[str, ...]:
    header = tuple(next(csv.reader(io.StringIO(line.lstrip("\ufeff"), newline="")), []))
    missing = [h for h in HEADER_TO_COLUMN if h not in header]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return header


def _by_header(spark: SparkSession, paths: list[str]) -> tuple[list[tuple[str, list[str]]], list[str]]:
    """Header lines and the files under each, and the files that have line breaks in quotes, from one pass.

    Within a split lines come in order, so the first one seen in a file's first split is its header. A file
    has breaks in quotes if any line of it would end inside quotes when begun outside them: the first
    such line does begin outside. An empty file has no header, which is an error.
    """
    if not paths:
        return [], []
    line = records.without_mark(F.col("value"))
    header = F.when(F.col("_metadata.file_block_start") == 0, F.col("value"))
    files = (spark.read.text([literal_path(p) for p in paths])
             .select(_file_path().alias("path"), header.alias("header"), records.ends_quoted(line, False).alias("broken"))
             .groupBy("path").agg(F.first("header", ignorenulls=True).alias("header"), F.max("broken").alias("broken")))
    groups = files.groupBy("broken", F.when(~F.col("broken"), F.col("header")).alias("header")).agg(
        F.sort_array(F.collect_list("path")).alias("paths")).collect()
    if sum(len(g["paths"]) for g in groups) < len(set(paths)):
        raise ValueError(f"a file is empty: missing columns {list(HEADER_TO_COLUMN)}")
    return (sorted((g["header"], g["paths"]) for g in groups if not g["broken"]),
            [p for g in groups if g["broken"] for p in g["paths"]])


def _grouped(headers: dict[str, str]) -> list[tuple[str, list[str]]]:
    groups = {}
    for path, header in sorted(headers.items()):
        groups.setdefault(header, []).append(path)
    return sorted(groups.items())


def _whole_headers(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """First records of files with line breaks in quotes."""
    lines = records.lines_of(spark, [literal_path(p) for p in paths], _file_path())
    return {r["path"]: r["header"] for r in records.headers(lines).collect()}


def _scan_broken(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """Files with line breaks in quotes: their records are cut from the lines of all splits, then parsed.

    The few files whose lines end in a carriage return alone cannot be split at line feeds: they are read
    in one piece each, with line feeds for their breaks in quotes.
    """
    headers = _whole_headers(spark, paths)
    for path in paths:
        if path not in headers:
            raise ValueError(f"{path}: missing columns {list(HEADER_TO_COLUMN)}: its first quote is not closed in its first split")
    returns = {p: h for p, h in headers.items() if "\r" in h.removesuffix("\r")}
    scans = [_scan(spark, group, _header(line.split("\r")[0], group[0]), True) for line, group in _grouped(returns)]
    split = sorted(set(paths) - set(returns))
    if not split:
        return scans
    parsed = {p: _header(headers[p].removesuffix("\r"), p) for p in split}
    places = spark.createDataFrame(
        [(p, len(h), [h.index(c) + 1 for c in HEADER_TO_COLUMN]) for p, h in parsed.items()], "path string, width int, places array<int>")
    width = max(map(len, parsed.values()))
    fields = [f"f{i}" for i in range(width)]
    schema = ", ".join(f"{f} string" for f in [*fields, _BROKEN])
    options = {"quote": '"', "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": _BROKEN}
    lines = records.lines_of(spark, [literal_path(p) for p in split], _file_path())
    rows = records.records_of(lines).join(F.broadcast(places), "path").withColumn("row", F.from_csv("record", schema, options))
    unquoted = F.regexp_replace("record", '"[^"]*"', "")
    checked = F.assert_true(F.size(F.split(unquoted, ",")) <= F.col("width"), F.concat(F.col("path"), F.lit(": a CSV record has too many fields")))
    texts = F.array(*[F.col(f"row.{f}") for f in fields])
    return [*scans, rows.where(checked.isNull()).select(
        *[F.element_at(texts, F.col("places")[i]).alias(c) for i, c in enumerate(HEADER_TO_COLUMN.values())], "path")]


def literal_path(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in path)


def _file_path() -> Column:
    # URL-encoded except for "+", which decoding would turn into a blank
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _reader(spark: SparkSession):
    return spark.read.option("header", True).option("quote", '"').option("escape", '"')


def _scan(spark: SparkSession, paths: list[str], header: tuple[str, ...],
          multi_line: bool) -> DataFrame:
    fields = [T.StructField(f"f{i}", T.StringType()) for i in range(len(header))]
    schema = T.StructType([*fields, T.StructField(_BROKEN, T.StringType())])
    rows = (_reader(spark).schema(schema).option("columnNameOfCorruptRecord", _BROKEN)
            .option("multiLine", multi_line).csv([literal_path(p) for p in paths]))
    unquoted = F.regexp_replace(_BROKEN, '"[^"]*"', "")
    complete = ~F.contains(unquoted, F.lit('"')) & (F.size(F.split(unquoted, ",")) <= len(header))
    checked = F.assert_true(
        F.coalesce(complete, F.lit(True)),
        "a CSV record has too many fields")
    return rows.where(checked.isNull()).select(
        *[F.col(f"f{header.index(h)}").alias(c) for h, c in HEADER_TO_COLUMN.items()],
        _file_path().alias("path"))


def _counts() -> list[str]:
    return [c for c in HEADER_TO_COLUMN.values() if c == "team_id" or c in LONG_COLUMNS]


def rejected_columns(texts: DataFrame) -> Column:
    """Count columns whose text, in this row, is neither missing nor a whole number: it becomes
    NULL, or loses its fraction."""
    names = []
    for name in _counts():
        text = F.when(~F.col(name).isin(*MISSING_TEXTS), F.col(name))
        number = F.trim(text).try_cast("double")
        bad = text.isNotNull() & ~F.coalesce((number % 1 == 0) & whole_number(text).isNotNull(), F.lit(False))
        names.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*names))


def typed_rows(texts: DataFrame) -> DataFrame:
    """Missing-value texts to NULL and counts to numbers; the fee stays text."""
    columns = {}
    for name in HEADER_TO_COLUMN.values():
        text = F.when(~F.col(name).isin(*MISSING_TEXTS), F.col(name))
        columns[name] = (whole_number(text) if name == "team_id" or name in LONG_COLUMNS
                         else text)
    return texts.withColumns(columns)


def raw_rows(texts: DataFrame, load_date: date | None = None) -> DataFrame:
    """Scanned texts (with ``path``) as rows of the raw table."""
    rows = with_lineage(typed_rows(texts), F.col("path"), load_date)
    return rows.withColumn("monthly_fee_currency", F.lit(None).cast("string")).select(
        *RAW_SCHEMA.names)


# --- load ----------------------------------------------------------------------------------

def ingest(spark: SparkSession, root: str, table_path: str, load_date: date | None = None,
           multi_line: bool = False, strict: bool = False, buckets: int = 0, replace: bool = False) -> DataFrame:
    """Load the new files below ``root``; running it again adds nothing.

    Returns one row per file of this run: path, snapshot_month, region, rows and what the ledger says of
    it, with ``skipped`` true (and no counts) for files with hidden names, which cannot be read.
    ``strict`` makes values that are no whole numbers an error; else they are counted.
    ``buckets`` lays the rows out by account (``raw_table.write_rows``), like the table's last load if
    not given.  ``replace`` loads all files, and switches the months and regions that are there already.
    """
    _, unread = hidden_files(spark, root)
    report = ingest_files(spark, list_files(spark, root), table_path, load_date, multi_line, strict, buckets, replace)
    names = spark.createDataFrame([(p,) for p in unread], "path string")
    return report.unionByName(with_file_keys(names).withColumn("skipped", F.lit(True)),
                              allowMissingColumns=True)


def ingest_files(spark: SparkSession, files: DataFrame, table_path: str,
                 load_date: date | None = None, multi_line: bool = False,
                 strict: bool = False, buckets: int = 0, replace: bool = False) -> DataFrame:
    """``ingest`` for a frame of files (``with_file_keys``).

    Each batch writes its rows beside those of the table, then the ledger takes in its months and
    regions: readers see all of a batch or nothing.  A load that breaks off in between is repeated
    by the next run, and of loads that run at once the first to enter a month and region has it.
    """
    ledger = open_ledger(spark, table_path)
    buckets = buckets or table_buckets(ledger)
    tried = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in RAW_PARTITIONS]))
    done = []
    while True:
        loaded = tried if replace else ledger.select(*RAW_PARTITIONS).union(tried)
        todo = new_files(files, loaded).orderBy("path").limit(FILES_PER_BATCH).collect()
        if not todo:
            break
        texts = scan_files(spark, [f["path"] for f in todo], multi_line)
        if strict:
            bad = rejected_columns(texts)
            texts = texts.where(F.assert_true(
                F.size(bad) == 0, F.concat(F.col("path"), F.lit(": no whole number in "), F.array_join(bad, ", "))).isNull())
        keys = spark.createDataFrame(todo, "snapshot_month string, region string, path string")
        with ThreadPoolExecutor(1) as beside:  # the write waits for files, the count for tasks
            counted = beside.submit(_loads(texts, keys).collect)
            folder = write_rows(raw_rows(texts, load_date), table_path, buckets)
        paths = {(f["snapshot_month"], f["region"]): f["path"] for f in todo}
        entries = [e.asDict(recursive=True) | {"folder": folder, "buckets": buckets} for e in counted.result()]
        done += [paths[key] for key in enter(spark, table_path, entries, replace)]
        tried = tried.union(keys.select(*RAW_PARTITIONS))
    paths = spark.createDataFrame([(p,) for p in done], "path string")
    return (read_ledger(spark, table_path).drop("folder", "buckets", "number", "other_rows", "busy")
            .join(paths, "path", "left_semi").withColumn("skipped", F.lit(False)))


def _loads(texts: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger rows of the scanned files; files without rows have zeros."""
    rows = texts.select("path", whole_number(F.col("team_id")).alias("team_id"), rejected_columns(texts).alias("bad"))
    keys = rows.groupBy("path", "team_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("bad")).alias("rejected"),
        F.array_distinct(F.flatten(F.collect_set("bad"))).alias("columns"))
    counts = keys.groupBy("path").agg(
        F.sum("n").alias("rows"), F.sum("rejected").alias("rejected"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("columns")))).alias("rejected_columns"),
        *busy_columns(),
        F.count_if((F.col("n") > 1) & F.col("team_id").isNotNull()).alias("duplicate_keys"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("rows", "rejected", "duplicate_keys", "most_rows", "other_rows")}
    # a file marks no test accounts, so all its rows count
    return (files.join(counts, "path", "left").withColumns(zero)
            .withColumn("kept_rows", F.col("rows")))
