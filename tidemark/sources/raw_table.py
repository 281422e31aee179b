"""The raw snapshot table: Parquet by month and region, one folder per load, and a ledger.

A load writes its rows beside all others, to ``_data/<load>/snapshot_month=.../region=...``, and then
enters its months and regions in the ledger. Only the ledger says which rows count: for each month
and region those of its newest entry. A load that breaks off before its entry changes nothing, and one
that replaces a month switches to the new rows by that one entry.

The ledger is a folder of numbered files. A file is created only if no other load has taken its
number, and ends with a line that says it is complete, so loads that run at once come one after the
other, and half a file counts as none. This needs a store that creates a file at most once.

A frame of the table is read through the session's catalog: its partitions are exactly the entries
of the ledger at that time. So the plan needs no list of files, a table written in buckets is read
in buckets, and frames read before a load keep to their rows.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Callable, Iterable
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.facts import Facts, with_facts
from tidemark.schema import RAW_PARTITIONS, RAW_SCHEMA
from tidemark.sources import numbered

LEDGER_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("snapshot_month", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("rows", T.LongType()),
    T.StructField("kept_rows", T.LongType()), T.StructField("rejected", T.LongType()),
    T.StructField("rejected_columns", T.ArrayType(T.StringType())),
    T.StructField("duplicate_keys", T.LongType()), T.StructField("most_rows", T.LongType()),
    T.StructField("other_rows", T.LongType()),
    T.StructField("busy", T.ArrayType(T.StructType([T.StructField("team_id", T.LongType()), T.StructField("rows", T.LongType())]))),
    T.StructField("folder", T.StringType()), T.StructField("buckets", T.IntegerType())])

_COMPLETE = "complete"

# An account with more rows than that in one month and region is named in the ledger, if at most so
# many accounts are: a thousandth of the rows at most, and 40 kB a month and region.
BUSY_ROWS, BUSY_ACCOUNTS = 1000, 1000

# Rows of a bucket: a task that takes one through the timeline's sorts needs about 1 kB a row.
BUCKET_ROWS = 700_000

# Called with the session after each load that it enters in a ledger.
AFTER_LOAD: list[Callable[[SparkSession], None]] = []


def read_raw_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows that count, or an empty frame of the same schema where nothing was written yet.

    A table without a ledger counts whole. The schema is given, so months stay text and no file is
    opened to infer types.
    """
    try:
        entries = read_ledger(spark, path).select(
            *RAW_PARTITIONS, "rows", "kept_rows", "most_rows", "other_rows", "busy", "folder", "buckets").collect()
    except AnalysisException as error:
        _only_not_found(error)
        return _plain(spark, path)
    held = [e for e in entries if e["rows"]]
    if not held:
        return spark.createDataFrame([], RAW_SCHEMA)
    rows = spark.table(_registered(spark, path, held)).select(*RAW_SCHEMA.names)
    months = sorted({e["snapshot_month"] for e in held if e["kept_rows"] and e["snapshot_month"]}, reverse=True)
    latest, previous = (*months, None, None)[:2]
    return with_facts(rows, Facts(latest, previous, *_account_bounds(held)))


def _account_bounds(entries: list[Row]) -> tuple[int, dict[int, int], int]:
    """``Facts.longest``, ``busy`` and ``others``: sums over entries, each of which bounds all accounts that
    it does not name by ``other_rows`` (by all its rows where it does not tell)."""
    def told(entry: Row, column: str) -> int:
        return entry["rows"] if entry[column] is None else entry[column]

    others, busy = sum(told(e, "other_rows") for e in entries), Counter()
    for e in entries:
        for account, n in e["busy"] or ():
            busy[account] += n - told(e, "other_rows")
    return sum(told(e, "most_rows") for e in entries), {i: n + others for i, n in busy.items()}, others


def _plain(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RAW_SCHEMA).parquet(path).select(*RAW_SCHEMA.names)
    except AnalysisException as error:
        _only_not_found(error)
        return spark.createDataFrame([], RAW_SCHEMA)


def _only_not_found(error: AnalysisException) -> None:
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error


def _registered(spark: SparkSession, path: str, entries: list[Row]) -> str:
    """Name of the catalog table whose partitions are ``entries``; made on first use."""
    base, buckets = path.rstrip("/"), {e["buckets"] for e in entries}
    key = json.dumps([base, sorted([e["folder"], str(e["snapshot_month"]), str(e["region"])] for e in entries)])
    name = f"tidemark_{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    if spark.catalog.tableExists(name):
        return name
    parts = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RAW_SCHEMA)
    # rows written in different numbers of buckets, or in none, are read without them
    number = buckets.pop() if len(buckets) == 1 else 0
    in_buckets = f"clustered by (team_id) sorted by (team_id) into {number} buckets" if number else ""
    spark.sql(f"create table {name} ({columns}) using parquet partitioned by ({', '.join(RAW_PARTITIONS)}) "
              f"{in_buckets} location {_literal(f'{base}/_data')}")
    clauses = []
    for e in entries:
        spec = ", ".join(f"{c} = {_literal(e[c])}" for c in RAW_PARTITIONS)
        folder = "/".join([base, *filter(None, [e["folder"]]), *(parts.getPartitionPathString(c, e[c]) for c in RAW_PARTITIONS)])
        clauses.append(f"partition ({spec}) location {_literal(folder)}")
    for at in range(0, len(clauses), 1000):
        spark.sql(f"alter table {name} add {' '.join(clauses[at:at + 1000])}")
    return name


def _literal(text: str | None) -> str:
    if text is None:
        return "null"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- writing -------------------------------------------------------------------------------

def append_rows(rows: DataFrame, path: str) -> None:
    """Append rows to a table without a ledger; tasks write straight to the partitions of their
    rows, unshuffled.  Where there is a ledger, rows come in by ``load_rows``."""
    rows.select(*RAW_SCHEMA.names).write.mode("append").partitionBy(*RAW_PARTITIONS).parquet(path)


def write_rows(rows: DataFrame, path: str, buckets: int = 0) -> str:
    """Write rows to a folder of their own, which is returned; they count once the ledger names it.

    With ``buckets``, rows are shuffled to as many tasks by account, and each writes one file per month
    and region.  Reading the table, Spark knows that, and needs no shuffle by account.
    """
    folder = f"_data/{uuid4().hex}"
    target = f"{path.rstrip('/')}/{folder}"
    rows = rows.select(*RAW_SCHEMA.names)
    if not buckets:
        rows.write.partitionBy(*RAW_PARTITIONS).parquet(target)
        return folder
    name = f"tidemark_load_{uuid4().hex}"  # only tables of a catalog are written in buckets
    (rows.repartition(buckets, "team_id").write.partitionBy(*RAW_PARTITIONS)
     .bucketBy(buckets, "team_id").sortBy("team_id").option("path", target).saveAsTable(name))
    rows.sparkSession.sql(f"drop table {name}")
    return folder


def buckets_for(rows: int) -> int:
    """Buckets for a table that is to hold so many rows, 4 at least: as many tasks read it."""
    return max(4, -(-rows // BUCKET_ROWS))


def load_rows(rows: DataFrame, path: str, buckets: int = 0, replace: bool = False) -> list[tuple[str, str]]:
    """Write rows and enter their months and regions; returns those that were entered: all that are
    not there yet, or with ``replace`` all."""
    spark = rows.sparkSession
    known = open_ledger(spark, path)
    buckets = buckets or table_buckets(known)
    folder = write_rows(rows, path, buckets)
    written = spark.read.schema(RAW_SCHEMA).parquet(f"{path.rstrip('/')}/{folder}")
    entries = [e.asDict(recursive=True) for e in _counts(written).collect()]
    return enter(spark, path, [e | {"folder": folder, "buckets": buckets} for e in entries], replace)


def busy_columns() -> list[Column]:
    """Aggregates over one row per ``team_id``, with its number of rows ``n``: the most rows of any account
    or without one (most_rows), the accounts with over ``BUSY_ROWS`` (busy), and the most rows of an account
    that is not among these (other_rows).  A load of too many busy accounts names none."""
    n, account = F.col("n"), F.col("team_id")
    listed = account.isNotNull() & (n > BUSY_ROWS)
    few = F.count_if(listed) <= BUSY_ACCOUNTS
    named = F.collect_list(F.when(listed, F.struct(account.alias("team_id"), n.alias("rows"))))
    return [
        F.max(n).alias("most_rows"),
        F.when(few, F.coalesce(F.max(F.when(account.isNotNull() & ~listed, n)), F.lit(0)))
        .otherwise(F.max(F.when(account.isNotNull(), n))).alias("other_rows"),
        F.when(few, named).alias("busy")]


def _counts(rows: DataFrame) -> DataFrame:
    """Ledger columns, as far as rows tell them, of each month and region."""
    keys = rows.groupBy(*RAW_PARTITIONS, "team_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("is_test"), F.lit(0)) == 0).alias("kept"))
    return keys.groupBy(*RAW_PARTITIONS).agg(
        F.sum("n").alias("rows"), F.sum("kept").alias("kept_rows"), *busy_columns(),
        F.count_if((F.col("n") > 1) & F.col("team_id").isNotNull()).alias("duplicate_keys"))


# --- the ledger ----------------------------------------------------------------------------

def _ledger_path(path: str) -> str:
    return f"{path.rstrip('/')}/_ledger"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """For each month and region its newest entry: file, rows, rows that count (no test accounts), values
    that were no whole numbers, their columns, keys with more than one row, the rows of its busiest
    accounts (``busy_columns``), the folder of its rows and the buckets they are written in, and the
    ``number`` of the load."""
    schema = T.StructType([*LEDGER_SCHEMA, T.StructField(_COMPLETE, T.BooleanType())])
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("long")
    lines = spark.read.schema(schema).json(_ledger_path(path)).select("*", number.alias("number"))
    complete = lines.where(_COMPLETE).select("number")
    entries = lines.where(F.col(_COMPLETE).isNull()).drop(_COMPLETE).join(complete, "number", "left_semi")
    newest = entries.groupBy(*RAW_PARTITIONS).agg(F.max_by(F.struct(*entries.columns), "number").alias("entry"))
    return newest.select("entry.*").select(*LEDGER_SCHEMA.names, "number")


def ledger_number(spark: SparkSession, path: str) -> int:
    """The number of the newest load, -1 before the first: it changes with every load."""
    return max(numbered.numbers(spark, _ledger_path(path)), default=-1)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; a table without one gets one that names all it holds now."""
    try:
        return read_ledger(spark, path)
    except AnalysisException as error:
        _only_not_found(error)
    held = [e.asDict(recursive=True) | {"folder": "", "buckets": 0} for e in _counts(_plain(spark, path)).collect()]
    enter(spark, path, held)
    return read_ledger(spark, path)


def table_buckets(ledger: DataFrame) -> int:
    """The buckets that the table's newest load wrote."""
    newest = ledger.agg(F.max_by("buckets", "number")).first()[0]
    return newest or 0


def enter(spark: SparkSession, path: str, entries: Iterable[dict], replace: bool = False) -> list[tuple[str, str]]:
    """Add ``entries`` to the ledger as one load; returns the months and regions that it now holds by it.

    Unless ``replace``, what another load has entered meanwhile stays and is left out here.  Of loads
    that take the same number all but one try again with the next.
    """
    entries = [{name: e.get(name) for name in LEDGER_SCHEMA.names} for e in entries]
    while True:
        # in this order: what comes in between has the number that is tried below
        found = numbered.numbers(spark, _ledger_path(path))
        held = read_ledger(spark, path).select(*RAW_PARTITIONS).collect() if found else []
        taken = set() if replace else {(r[0], r[1]) for r in held}
        ours = [e for e in entries if (e["snapshot_month"], e["region"]) not in taken]
        if not ours and found:
            return []
        lines = [*map(json.dumps, ours), json.dumps({_COMPLETE: True})]
        if numbered.create(spark, _ledger_path(path), max(found, default=-1) + 1, lines):
            for tell in AFTER_LOAD:
                tell(spark)
            return sorted(((e["snapshot_month"], e["region"]) for e in ours), key=str)
