"""The account timeline as a table that follows a raw table month by month.

Each update writes what it adds to folders of its own, and a numbered version file then names the
folders that make up the table: settled rows of all updates, and the open rows and states of the last.
Readers of a version keep to it. An update that breaks off leaves no version.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import Bounds
from tidemark.operators.incremental import advance, begun, completed, is_open
from tidemark.plans.snapshots import clients_clean
from tidemark.sources import numbered
from tidemark.sources.raw_table import open_ledger, read_raw_table


@dataclass(frozen=True)
class Version:
    """The folders of a version, and what it was built from (month: its loads in the raw table's ledger)."""

    number: int
    settled: list[str]
    open: list[str]
    state: str
    months: dict[str, str]


def _versions(path: str) -> str:
    return f"{path.rstrip('/')}/_versions"


def newest_version(spark: SparkSession, path: str) -> Version | None:
    for number in reversed(numbered.numbers(spark, _versions(path))):
        lines = [r[0] for r in spark.read.text(f"{_versions(path)}/{number:012d}.json").collect()]
        if len(lines) == 1 and lines[0].endswith("}}"):  # one line, written to its end
            return Version(number, **json.loads(lines[0]))
    return None


def update_timeline(spark: SparkSession, raw_path: str, path: str, layout: str | Bounds = "auto") -> Version:
    """Bring the timeline at ``path`` up to the raw table at ``raw_path``.

    Months after the newest one so far are taken in by themselves: their rows, the open rows and
    the states are read, no settled row.  A month that comes late, or that a load has replaced, begins
    the table anew.  Of updates at once one counts.
    """
    while True:
        number = max(numbered.numbers(spark, _versions(path)), default=-1) + 1
        last = newest_version(spark, path)
        loads = (open_ledger(spark, raw_path).where("kept_rows > 0").groupBy("snapshot_month")
                 .agg(F.sort_array(F.collect_list(F.concat_ws(":", "region", "number"))).alias("loads")).collect())
        months = {r["snapshot_month"]: ",".join(r["loads"]) for r in loads if r["snapshot_month"]}
        if not months:
            raise ValueError(f"{raw_path}: no month with rows that count")
        fresh = sorted(m for m in months if last is None or m not in last.months)
        follows = last is not None and all(months.get(m) == loads for m, loads in last.months.items())
        if follows and not fresh:
            return last
        clean = clients_clean(read_raw_table(spark, raw_path))
        if follows and fresh[0] > max(last.months):
            later = clean.where(F.col("snapshot_month").isin(fresh))
            open_rows = _read(spark, path, last.open or last.settled)
            rows, state = advance(_read(spark, path, [last.state]), open_rows if last.open else open_rows.limit(0), later)
            earlier = last.settled
        else:
            rows, state = begun(clean, layout)
            earlier = []
        settled, still_open = _write_rows(rows, path)
        state_folder = f"_data/{uuid4().hex}"
        state.write.parquet(f"{path.rstrip('/')}/{state_folder}")
        version = {"settled": [*earlier, *settled], "open": still_open, "state": state_folder, "months": months}
        if numbered.create(spark, _versions(path), number, [json.dumps(version)]):
            return Version(number, **version)


def _write_rows(rows: DataFrame, path: str) -> tuple[list[str], list[str]]:
    """The folders of the settled and of the open rows, none where there are no such rows."""
    folder = f"_data/{uuid4().hex}"
    rows.withColumn("is_open", is_open()).write.partitionBy("is_open").parquet(f"{path.rstrip('/')}/{folder}")
    parts = [f"{folder}/is_open={part}" for part in ("false", "true")]
    return tuple([p] if numbered.exists(rows.sparkSession, f"{path.rstrip('/')}/{p}") else [] for p in parts)


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{path.rstrip('/')}/{f}" for f in folders])


def read_timeline(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """``history.account_timeline`` of all rows with an account id, from the newest version."""
    version = version or newest_version(spark, path)
    if version is None:
        raise ValueError(f"{path}: no timeline yet")
    parts = [_read(spark, path, [f]) for f in [*version.settled, *version.open]]
    return completed(reduce(DataFrame.unionByName, parts), _read(spark, path, [version.state]))
