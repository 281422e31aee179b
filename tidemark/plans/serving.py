"""Serving queries.

Each works on all accounts at once, keyed by account; passing ``team_id`` (or filtering
the result on it) gives one account's answer.  The filter is on the partition key of every
window, so Spark moves it down to the scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.history import Bounds
from tidemark.plans.accounts import at_risk_next_actions, company_overview, onboarding_clients
from tidemark.plans.health import health_score_monthly, scored_history
from tidemark.plans.snapshots import (
    at_risk_watchlist, latest_snapshot, months_between_texts, snapshot_months, stage_of, start_date)
from tidemark.rules import STANDARD, Rules


def _of_account(rows: DataFrame, team_id: int | None) -> DataFrame:
    return rows if team_id is None else rows.where(F.col("team_id") == team_id)


_COMPANY = ["team_id", "company_name", "company_size", "region", "monthly_fee", "client_stage",
            "overall_health_score", "salesperson"]


def load_companies(clean: DataFrame, rules: Rules = STANDARD, ordered: bool = True,
                   layout: str | Bounds = "auto") -> DataFrame:
    rows = company_overview(clean, rules, layout).select(*_COMPANY).distinct()
    return rows.orderBy("company_name", "team_id") if ordered else rows


def companies_without_score(clean: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """The companies' rows without the one column that needs their whole history: equal rows
    have equal scores, so ``distinct`` keeps as many."""
    stage = stage_of(months_between_texts(F.col("first_seen_month"), F.col("snapshot_month"), rules),
                     rules.overview_onboarding_months)
    return (latest_snapshot(clean).join(start_date(clean), "team_id", "left")
            .withColumn("client_stage", stage)
            .select(*[c for c in _COMPANY if c != "overall_health_score"]).distinct())


def load_monthly_usage(clean: DataFrame, team_id: int | None = None,
                       rules: Rules = STANDARD, layout: str | Bounds = "auto") -> DataFrame:
    """Usage with score per month; an account's months are in order.

    Usage and score are columns of the same timeline row, so there is no join.
    """
    return (
        _of_account(scored_history(clean, rules, layout), team_id)
        .where(F.col("team_id").isNotNull())
        .select("team_id", "snapshot_month", "total_clicks_wo_api", "active_users",
                "jobs_posted", "active_coddlers", "overall_health_score")
        .sortWithinPartitions("team_id", "snapshot_month")
    )


def load_risk_flag(clean: DataFrame, as_of: datetime | None = None, team_id: int | None = None,
                   rules: Rules = STANDARD) -> DataFrame:
    """Risk and contract, one row per account; of copies that differ, the least."""
    rows = _of_account(at_risk_watchlist(clean, as_of, rules), team_id)
    answer = F.struct("risk_flag", "contract_status", "days_to_contract_end",
                      "latest_contract_end_date")
    return (rows.where(F.col("team_id").isNotNull()).groupBy("team_id")
            .agg(F.min(answer).alias("answer")).select("team_id", "answer.*"))


def load_at_risk_clients(clean: DataFrame, as_of: datetime | None = None,
                         rules: Rules = STANDARD, ordered: bool = True,
                         layout: str | Bounds = "auto") -> DataFrame:
    return (at_risk_next_actions(clean, as_of, rules, ordered, layout)
            .where(F.col("overall_health_score") <= rules.at_risk_at_most)
            .select("company_name", "overall_health_score", "health_narrative",
                    "company_size", "monthly_fee", "salesperson"))


def load_clients_to_review(clean: DataFrame, as_of: datetime | None = None,
                           rules: Rules = STANDARD, ordered: bool = True,
                           layout: str | Bounds = "auto") -> DataFrame:
    return at_risk_next_actions(clean, as_of, rules, ordered, layout).select(
        "company_name", "team_id", "region", "salesperson", "overall_health_score",
        "health_band", "health_narrative", "risk_flag", "contract_status",
        "days_to_contract_end", "user_trend", "engagement_delta", "company_size",
        "monthly_fee", "recommended_action")


def load_health_scores(clean: DataFrame, team_id: int | None = None,
                       rules: Rules = STANDARD, layout: str | Bounds = "auto") -> DataFrame:
    return (_of_account(health_score_monthly(clean, rules, layout=layout), team_id)
            .where(F.col("team_id").isNotNull())
            .select("team_id", "snapshot_month", "health_score")
            .sortWithinPartitions("team_id", "snapshot_month"))


def load_latest_health_summary(clean: DataFrame, team_id: int | None = None,
                               rules: Rules = STANDARD,
                               layout: str | Bounds = "auto") -> DataFrame:
    """Newest score, band and narrative of each account, gone accounts included.

    The timeline already counts an account's rows from the newest one.
    """
    rows = _of_account(scored_history(clean, rules, layout), team_id)
    return (rows.where(F.col("team_id").isNotNull() & (F.col("rows_from_here") == 1))
            .select("team_id", "snapshot_month", "overall_health_score", "health_band",
                    "health_narrative"))


def load_onboarding_clients(clean: DataFrame, team_id: int | None = None,
                            rules: Rules = STANDARD) -> DataFrame:
    """Newest month and age band of each onboarding account.

    Such an account is in the latest snapshot, so its newest row lies there.
    """
    rows = _of_account(onboarding_clients(clean, rules), team_id)
    return (rows.where(F.col("snapshot_month") == snapshot_months(clean)["latest"])
            .select("team_id", "snapshot_month", "onboarding_age_band"))
