"""Query names and the callables behind them: ``(spark, sf_dir) -> DataFrame``.

The raw table of every query is the panel derived from the tables in ``sf_dir``.  Its
grouping leaves one row per account and month, and it holds 82 months whatever the size of
the tables, so no history is long: these queries run in the ``window`` layout.  The ``_hot``
ones take a panel with one very long history and many rows without an account id.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.checks import duplicate_keys
from tidemark.operators.history import Bounds
from tidemark.plans import dashboard, serving
from tidemark.plans.accounts import at_risk_next_actions
from tidemark.plans.catalog import VIEWS, follow_table, register_views, sql_to_frame, view
from tidemark.plans.health import scored_timeline
from tidemark.plans.snapshots import clients_clean, latest_snapshot, snapshot_months
from tidemark.plans.trends import user_trend_monthly
from tidemark.rules import HEADER_TO_COLUMN, STANDARD
from tidemark.schema import RAW_PARTITIONS, RAW_SCHEMA, VIEW_COLUMNS
from tidemark.sources import csv_files
from tidemark.sources.panel import AS_OF, expected_rows, hot_panel, panel, write_csv_files
from tidemark.sources.raw_table import append_rows, buckets_for, load_rows, read_raw_table
from tidemark.sources.timeline_table import read_timeline, update_timeline

Query = Callable[[SparkSession, str], DataFrame]

LOAD_DATE = date(2001, 10, 15)


@lru_cache(maxsize=8)
def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's plan, built once per session; its rows are computed by every query."""
    return panel(spark, sf_dir)


def _view(name: str, layout: str = "window") -> Query:
    return lambda spark, sf_dir: view(name, _panel(spark, sf_dir), AS_OF, layout=layout)


def _on_clean(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(clients_clean(_panel(spark, sf_dir)))


def _on_companies(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_clean(lambda clean: build(
        serving.load_companies(clean, ordered=False, layout="window")))


def _on_usage(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_clean(lambda clean: build(serving.load_monthly_usage(clean, layout="window")))


def _on_at_risk(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_clean(lambda clean: build(
        serving.load_at_risk_clients(clean, AS_OF, ordered=False, layout="window")))


def _on_review(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_clean(lambda clean: build(
        serving.load_clients_to_review(clean, AS_OF, ordered=False, layout="window")))


SERVING: dict[str, Query] = {
    "load_companies": _on_clean(lambda clean: serving.load_companies(clean, layout="window")),
    "load_monthly_usage": _on_usage(lambda rows: rows),
    "load_risk_flag": _on_clean(lambda clean: serving.load_risk_flag(clean, AS_OF)),
    "load_at_risk_clients": _on_clean(
        lambda clean: serving.load_at_risk_clients(clean, AS_OF, layout="window")),
    "load_clients_to_review": _on_clean(
        lambda clean: serving.load_clients_to_review(clean, AS_OF, layout="window")),
    "load_health_scores": _on_clean(
        lambda clean: serving.load_health_scores(clean, layout="window")),
    "load_latest_health_summary": _on_clean(
        lambda clean: serving.load_latest_health_summary(clean, layout="window")),
    "load_onboarding_clients": _on_clean(serving.load_onboarding_clients),
}

# What a user may pick on each page: two sizes, two regions, some sales people.
PICKED = {
    "at_risk": {"company_size": ["medium", "large"],
                "salesperson": ["Rep 1", "Rep 2", "Rep 3", "Rep 5"]},
    "clients": {"company_size": ["medium", "small"], "salesperson": ["Rep 0", "Rep 4", "Rep 6"],
                "region": ["AFRICA", "ASIA", "EUROPE"]},
    "review": {"health_band": ["Critical", "Healthy"], "company_size": ["medium", "large"],
               "salesperson": ["Rep 1", "Rep 2", "Rep 5"], "region": ["AFRICA", "AMERICA"]},
}


DASHBOARD: dict[str, Query] = {
    "critical_count": _on_at_risk(dashboard.critical_count),
    "onboarding_count": _on_clean(
        lambda clean: dashboard.onboarding_count(serving.companies_without_score(clean))),
    "growth_opportunity_pct": _on_companies(dashboard.growth_opportunity_pct),
    "latest_month": _on_usage(dashboard.latest_month),
    "at_risk_sorted": _on_at_risk(dashboard.at_risk_sorted),
    "filter_at_risk": _on_at_risk(
        lambda rows: dashboard.keep_selected(rows, PICKED["at_risk"])),
    "filter_clients": _on_companies(
        lambda rows: dashboard.keep_selected(rows, PICKED["clients"])),
    "filter_review": _on_review(
        lambda rows: dashboard.keep_selected(rows, PICKED["review"])),
    "filter_default_selection": _on_review(dashboard.keep_with_default_selection),
    "filter_options_at_risk": _on_at_risk(
        lambda rows: dashboard.filter_options(rows, dashboard.AT_RISK_FILTERS)),
    "filter_options_clients": _on_companies(
        lambda rows: dashboard.filter_options(rows, dashboard.CLIENT_FILTERS)),
    "filter_options": _on_review(
        lambda rows: dashboard.filter_options(rows, dashboard.REVIEW_FILTERS)),
    "band_counts": _on_review(dashboard.band_counts),
    "band_counts_filtered": _on_review(
        lambda rows: dashboard.band_counts(dashboard.keep_selected(rows, PICKED["review"]))),
    "client_lookup": _on_companies(dashboard.client_lookup),
    "prepare_time_series": _on_usage(dashboard.prepare_time_series),
    "usage_series": _on_usage(dashboard.usage_series),
    "fee_per_latest_user": _on_clean(
        lambda clean: dashboard.fee_per_latest_user(latest_snapshot(clean))),
    "latest_users": _on_usage(dashboard.latest_users),
    "fee_display": _on_review(
        lambda rows: dashboard.review_display(rows).select("team_id", "fee_display")),
    "days_display": _on_review(
        lambda rows: dashboard.review_display(rows).select("team_id", "days_display")),
    "size_display": _on_review(
        lambda rows: dashboard.review_display(rows).select("team_id", "size_display")),
    "review_table": _on_review(dashboard.review_table),
}


# --- ingest: the panel as it comes in files -------------------------------------------------

def shared_folder(spark: SparkSession) -> str:
    """A new folder that the cluster shares: below ``spark.checkpoint.dir``, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/tidemark-{uuid4().hex}"


@lru_cache(maxsize=8)
def _dropped(spark: SparkSession, sf_dir: str) -> str:
    """The whole panel as ``drop/<region>/<YYYY-MM>.csv`` below a shared folder, written once per
    session; files of odd months have their columns in another order and one more."""
    folder = f"{shared_folder(spark)}/drop"
    rows = _panel(spark, sf_dir)
    headers = [F.col(c).cast("string").alias(h) for h, c in HEADER_TO_COLUMN.items()]
    odd = F.substring("snapshot_month", 6, 2).cast("int") % 2 == 1
    write_csv_files(rows.where(~odd), headers, folder)
    write_csv_files(rows.where(odd), [F.lit("x").alias("Extra"), *reversed(headers)], folder)
    return folder


def _below_drop() -> Column:
    return F.regexp_extract("path", "/drop/[^/]+/[^/]+$", 0).alias("path")


def _as_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's files found and read: column texts and the path, from ``/drop`` on, of each row."""
    paths = [row["path"] for row in csv_files.list_files(spark, _dropped(spark, sf_dir)).collect()]
    return csv_files.scan_files(spark, paths).withColumn("path", _below_drop())


def _ingest_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files loaded into a new table, and once more, which adds nothing."""
    table = f"{shared_folder(spark)}/clients_raw"
    for _ in range(2):
        csv_files.ingest(spark, _dropped(spark, sf_dir), table, LOAD_DATE)
    return read_raw_table(spark, table)


def _ingest_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{shared_folder(spark)}/clients_raw"
    append_rows(csv_files.raw_rows(_as_scanned(spark, sf_dir), LOAD_DATE), table)
    return read_raw_table(spark, table)


def _ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = csv_files.ingest(
        spark, _dropped(spark, sf_dir), f"{shared_folder(spark)}/clients_raw", LOAD_DATE)
    return report.select(csv_files.source_file_of(F.col("path")).alias("source_file"), "rows")


def _ingest_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load of all files adds where the files of two regions are loaded already."""
    table = f"{shared_folder(spark)}/clients_raw"
    files = csv_files.list_files(spark, _dropped(spark, sf_dir))
    csv_files.ingest_files(spark, files.where(F.col("region").isin("ASIA", "EUROPE")), table, LOAD_DATE)
    added = csv_files.ingest_files(spark, files, table, LOAD_DATE)
    return read_raw_table(spark, table).join(added.select(*RAW_PARTITIONS), RAW_PARTITIONS, "left_semi")


def _ingest_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to load when each lies in two folders and one region is loaded already."""
    once = csv_files.list_files(spark, _dropped(spark, sf_dir)).select(_below_drop())
    twice = once.select(F.explode(F.array(
        "path", F.replace("path", F.lit("/drop/"), F.lit("/again/")))).alias("path"))
    files = csv_files.with_file_keys(twice)
    return csv_files.new_files(files, files.where(F.col("region") == "AFRICA"))


def _ingest_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose company names hold line breaks, quotes and commas, some of them below a hidden folder."""
    folder = f"{shared_folder(spark)}/drop"
    name = F.concat("company_name", F.lit('\n"new", line\n'), F.col("total_clicks").cast("string"))
    headers = [(name if c == "company_name" else F.col(c).cast("string")).alias(h) for h, c in HEADER_TO_COLUMN.items()]
    rows, hidden = _panel(spark, sf_dir), F.col("region").isin("ASIA", "EUROPE")
    write_csv_files(rows.where(~hidden), headers, f"{folder}/seen")
    write_csv_files(rows.where(hidden), headers, f"{folder}/deep/_hidden")
    table = f"{shared_folder(spark)}/clients_raw"
    csv_files.ingest(spark, folder, table, LOAD_DATE)
    return read_raw_table(spark, table)


def _ingest_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files loaded, and those of two regions once more in place of their rows, on another day."""
    table, files = f"{shared_folder(spark)}/clients_raw", csv_files.list_files(spark, _dropped(spark, sf_dir))
    csv_files.ingest_files(spark, files, table, date(2001, 1, 1))
    csv_files.ingest_files(spark, files.where(F.col("region").isin("ASIA", "EUROPE")), table, LOAD_DATE, replace=True)
    return read_raw_table(spark, table)


def _lineage(*columns: str) -> Query:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = csv_files.with_lineage(_as_scanned(spark, sf_dir), F.col("path"), LOAD_DATE)
        return rows.select("team_id", "path", *columns)
    return build


def _sql_to_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(_panel(spark, sf_dir), AS_OF, layout="window")
    return sql_to_frame(
        spark, "select company_name, overall_health_score, health_band, recommended_action "
        "from at_risk_next_actions where overall_health_score <= ? and region <> ?",
        [60, "ASIA"])


INGEST: dict[str, Query] = {
    "fixture_panel": lambda spark, sf_dir: _panel(spark, sf_dir),
    "ingest_scan": lambda spark, sf_dir: csv_files.typed_rows(
        _as_scanned(spark, sf_dir)).drop("path"),
    "ingest_rename": lambda spark, sf_dir: csv_files.raw_rows(
        _as_scanned(spark, sf_dir), LOAD_DATE).select(*HEADER_TO_COLUMN.values()),
    "ingest_load": _ingest_load,
    "ingest_line_breaks": _ingest_line_breaks,
    "ingest_replace": _ingest_replace,
    "ingest_region": _lineage("region"),
    "ingest_month": _lineage("snapshot_month"),
    "ingest_lineage": _lineage("source_file", "load_date", "is_test"),
    "ingest_new_files": _ingest_new_files,
    "ingest_idempotent": _ingest_idempotent,
    "ingest_append": _ingest_append,
    "ingest_report": _ingest_report,
    "raw_table": lambda spark, sf_dir: _ingest_append(spark, sf_dir).select(*RAW_SCHEMA.names),
    "sql_to_frame": _sql_to_frame,
}

# The layout for long histories gives the same rows.
LONG_HISTORY: dict[str, Query] = {
    "user_monthly_penalty_blocks": _view("user_monthly_penalty", "blocks"),
    "overall_health_score_blocks": _view("overall_health_score", "blocks"),
    "health_score_monthly_enriched_blocks": _view("health_score_monthly_enriched", "blocks"),
    "engagement_trend_blocks": _view("engagement_trend", "blocks"),
    "at_risk_next_actions_blocks": _on_clean(
        lambda clean: at_risk_next_actions(clean, AS_OF, layout="blocks")),
}

# Small limits, so that the tables of any size have accounts beyond them.
HOT_BOUNDS = Bounds(history_rows=200, block_rows=100)


def _on_hot(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(clients_clean(hot_panel(_panel(spark, sf_dir))))


HOT: dict[str, Query] = {
    f"{name}_hot": _on_hot(lambda clean, name=name: VIEWS[name](clean, AS_OF, STANDARD, HOT_BOUNDS))
    for name in ("monthly_usage", "user_monthly_penalty", "user_sharp_decline_penalty",
                 "overall_health_score", "health_score_monthly_enriched", "at_risk_next_actions")
} | {
    "load_monthly_usage_hot": _on_hot(
        lambda clean: serving.load_monthly_usage(clean, layout=HOT_BOUNDS)),
    "load_latest_health_summary_hot": _on_hot(
        lambda clean: serving.load_latest_health_summary(clean, layout=HOT_BOUNDS)),
}

# --- the panel as a table of the library, loaded in parts ------------------------------------

def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The panel, computed once for all its parts."""
    month, folder = F.col("snapshot_month"), f"{shared_folder(spark)}/panel"
    _panel(spark, sf_dir).write.parquet(folder)
    rows = spark.read.schema(RAW_SCHEMA).parquet(folder)
    return [rows.where(month < "1999-01-01"), rows.where((month >= "1999-01-01") & (month < "2001-10-01")), rows.where(month >= "2001-10-01")]


@lru_cache(maxsize=8)
def _stored(spark: SparkSession, sf_dir: str) -> str:
    """A raw table in buckets by account and the timeline that followed its loads, written once per session.

    The buckets grow with the tables, so that no task gets more rows for that.
    """
    folder, buckets = shared_folder(spark), buckets_for(expected_rows(spark, sf_dir))
    for part in _parts(spark, sf_dir):
        load_rows(part, f"{folder}/clients_raw", buckets=buckets)
        update_timeline(spark, f"{folder}/clients_raw", f"{folder}/timeline")
    return folder


def _on_stored(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(clients_clean(read_raw_table(spark, f"{_stored(spark, sf_dir)}/clients_raw")))


def _kept_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of accounts with an id, from the timeline kept load by load."""
    folder = _stored(spark, sf_dir)
    clean = clients_clean(read_raw_table(spark, f"{folder}/clients_raw"))
    scored = scored_timeline(read_timeline(spark, f"{folder}/timeline"), snapshot_months(clean)["latest"])
    return scored.select(*VIEW_COLUMNS["health_score_monthly_enriched"])


def _sql_of_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views registered before the table's last load, which they follow."""
    table = f"{shared_folder(spark)}/clients_raw"
    first, *later = _parts(spark, sf_dir)
    load_rows(first, table)
    follow_table(spark, table, AS_OF)
    for part in later:
        load_rows(part, table)
    return sql_to_frame(
        spark, "select company_name, overall_health_score, health_band, recommended_action "
        "from at_risk_next_actions where overall_health_score <= ? and region <> ?",
        [60, "ASIA"])


STORED: dict[str, Query] = {
    **{f"{name}_stored": _on_stored(lambda clean, name=name: VIEWS[name](clean, AS_OF, STANDARD, "auto"))
       for name in ("latest_snapshot", "growth_summary", "monthly_usage", "overall_health_score",
                    "at_risk_next_actions", "onboarding_clients")},
    "load_monthly_usage_of_account_stored": _on_stored(lambda clean: serving.load_monthly_usage(clean, 5)),
    "health_score_monthly_enriched_kept": _kept_score,
    "sql_to_frame_followed": _sql_of_followed,
}

ONE_ACCOUNT: dict[str, Query] = {
    "latest_month_of_account": _on_usage(lambda rows: dashboard.latest_month(rows, team_id=1)),
    "load_monthly_usage_of_account": _on_clean(
        lambda clean: serving.load_monthly_usage(clean, 5, layout="window")),
    "load_risk_flag_of_account": _on_clean(
        lambda clean: serving.load_risk_flag(clean, AS_OF, 5)),
    "load_health_scores_of_account": _on_clean(
        lambda clean: serving.load_health_scores(clean, 5, layout="window")),
    "load_latest_health_summary_of_account": _on_clean(
        lambda clean: serving.load_latest_health_summary(clean, 5, layout="window")),
    "user_trend_monthly_corrected": _on_clean(
        lambda clean: user_trend_monthly(clean, corrected=True)),
    "duplicate_keys": lambda spark, sf_dir: duplicate_keys(
        _panel(spark, sf_dir).withColumn("team_id", F.col("team_id") % 7)),
}

QUERIES: dict[str, Query] = {
    **{name: _view(name) for name in VIEWS}, **SERVING, **DASHBOARD, **INGEST, **LONG_HISTORY,
    **HOT, **STORED, **ONE_ACCOUNT}
