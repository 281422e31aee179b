"""Dashboard data: counts, filters, options, series and display columns.

Inputs are the serving frames: ``companies`` (load_companies), ``at_risk``
(load_at_risk_clients), ``review`` (load_clients_to_review), ``usage``
(load_monthly_usage).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules as r
from tidemark.functions.display import capitalised, days_text, fee_text
from tidemark.functions.numbers import ratio, round_exact, round_scaled
from tidemark.rules import STANDARD, Rules

# What each page filters on, and the dimension whose missing values are no option.
AT_RISK_FILTERS = ("company_size", "salesperson")
CLIENT_FILTERS = ("company_size", "salesperson", "region")
REVIEW_FILTERS = ("health_band", "company_size", "salesperson", "region")
OPTIONAL_DIMENSION = "salesperson"

# The measures of the usage page and the columns of the review page.
SERIES = ("total_clicks_wo_api", "jobs_posted", "active_users", "active_coddlers",
          "overall_health_score")

REVIEW_TABLE = ("company_name", "salesperson", "company_size", "region", "monthly_fee",
                "overall_health_score", "health_band", "recommended_action",
                "contract_status", "days_to_contract_end")


def critical_count(at_risk: DataFrame) -> DataFrame:
    return at_risk.agg(F.count(F.lit(1)).alias("critical_count"))


def onboarding_count(companies: DataFrame) -> DataFrame:
    onboarding = F.col("client_stage") == r.STAGE_ONBOARDING
    return companies.agg(F.count_if(onboarding).alias("onboarding_count"))


def growth_opportunity_pct(companies: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """Share of all accounts with a score above the growth bound; NULL without accounts."""
    above = F.count_if(F.col("overall_health_score") > rules.growth_above)
    share = companies.agg((ratio(above, F.count(F.lit(1))) * 100).alias("share"))
    return share.select(round_exact(F.col("share"), 1).alias("growth_opportunity_pct"))


def latest_month(usage: DataFrame, team_id: int | None = None) -> DataFrame:
    """Newest month with usage, of one account or of all."""
    rows = usage if team_id is None else usage.where(F.col("team_id") == team_id)
    return rows.agg(F.max("snapshot_month").alias("latest_month"))


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Sorted by ``keys``, missing values last, and by all else, so that the ranges of the sort split rows
    with equal keys; the exchange before it, by whole rows too, lets its sample read shuffled rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.repartition(*rows.columns).orderBy(*[F.asc_nulls_last(k) for k in keys], *rest)


def at_risk_sorted(at_risk: DataFrame) -> DataFrame:
    return _in_order(at_risk, "overall_health_score", "company_size")


def keep_selected(rows: DataFrame, selected: dict[str, Iterable[str]]) -> DataFrame:
    """Rows whose value is among the selected ones, for every dimension given."""
    for dimension, values in selected.items():
        rows = rows.where(F.col(dimension).isin(*values))
    return rows


def keep_with_default_selection(rows: DataFrame) -> DataFrame:
    """The same with every offered option selected.  A missing salesperson is never
    offered, so those rows go even then."""
    return rows.where(F.col(OPTIONAL_DIMENSION).isNotNull())


def filter_options(rows: DataFrame, dimensions: Iterable[str]) -> DataFrame:
    """Sorted distinct values per dimension, in one pass over the rows."""
    pairs = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("option")) for d in dimensions])
    offered = ((F.col("pair.dimension") != OPTIONAL_DIMENSION)
               | F.col("pair.option").isNotNull())
    return (rows.select(F.explode(pairs).alias("pair")).where(offered)
            .select("pair.*").distinct().orderBy("dimension", "option"))


def band_counts(review: DataFrame) -> DataFrame:
    """Accounts per band; all bands always shown."""
    return review.agg(*[
        F.count_if(F.col("health_band") == band).alias(band.lower().replace(" ", "_"))
        for band in r.BANDS])


def client_lookup(companies: DataFrame, company_name: str | None = None) -> DataFrame:
    """The account behind each company name (the lowest id when names repeat)."""
    rows = companies
    if company_name is not None:
        rows = rows.where(F.col("company_name") == company_name)
    return rows.groupBy("company_name").agg(F.min("team_id").alias("team_id"))


def prepare_time_series(rows: DataFrame, date_col: str = "snapshot_month") -> DataFrame:
    """Month as a date, in order of time: all rows of one account's frame, or each account's
    rows of a keyed frame (which its accounts already partition)."""
    dated = rows.withColumn(date_col, F.to_date(date_col))
    if "team_id" in dated.columns:
        return dated.sortWithinPartitions("team_id", date_col)
    return dated.orderBy(date_col)


def usage_series(usage: DataFrame) -> DataFrame:
    """Long form: one row per account, month and measure."""
    points = F.array(*[
        F.struct(F.lit(s).alias("series"), F.col(s).cast("bigint").alias("value"))
        for s in SERIES])
    return (usage.select("team_id", "snapshot_month", F.explode(points).alias("point"))
            .select("team_id", "snapshot_month", "point.*"))


def latest_users(usage: DataFrame) -> DataFrame:
    """Users in each account's newest month."""
    return usage.groupBy("team_id").agg(
        F.max_by("active_users", "snapshot_month").alias("latest_users"))


def fee_per_latest_user(latest: DataFrame) -> DataFrame:
    """``latest``: the latest snapshot.  An account there has its newest users in the same row."""
    per_user = round_scaled(ratio(F.col("monthly_fee"), F.col("active_users")), 2)
    return (latest.where(F.col("team_id").isNotNull())
            .select("team_id", per_user.alias("fee_per_user")).distinct())


def display_columns() -> dict[str, Column]:
    return {
        "fee_display": fee_text(F.col("monthly_fee"), F.col("region")),
        "days_display": days_text(F.col("days_to_contract_end")),
        "size_display": capitalised(F.col("company_size")),
    }


def review_display(review: DataFrame) -> DataFrame:
    return review.select("team_id", *[c.alias(n) for n, c in display_columns().items()])


def review_table(review: DataFrame) -> DataFrame:
    return _in_order(review.select(*REVIEW_TABLE), "overall_health_score")
