"""One row per account of the latest snapshot: overview, next action, onboarding."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules as r
from tidemark.functions.dates import lenient_day
from tidemark.functions.numbers import below_band
from tidemark.plans.health import scored_latest
from tidemark.plans.snapshots import (
    latest_snapshot, months_between_texts, snapshot_months, stage_of, start_date,
    with_risk_columns)
from tidemark.rules import STANDARD, Rules
from tidemark.schema import VIEW_COLUMNS


def company_overview(clean: DataFrame, rules: Rules = STANDARD,
                     layout: str = "window") -> DataFrame:
    known = F.col("team_id").isNotNull()
    months = months_between_texts(F.col("first_seen_month"), F.col("snapshot_month"), rules)
    return (
        scored_latest(clean, rules, layout)
        .withColumns({
            "months_since_start": F.when(known, months),
            "overall_health_score": F.when(known, F.col("overall_health_score")),
        })
        .withColumn("client_stage", stage_of(F.col("months_since_start"),
                                             rules.overview_onboarding_months))
        .select(*VIEW_COLUMNS["company_overview"])
    )


def recommended_action(rules: Rules = STANDARD) -> Column:
    score, status = F.col("overall_health_score"), F.col("contract_status")
    worth_review = (F.col("company_size").isin(r.SIZE_MEDIUM, r.SIZE_LARGE)
                    & score.between(*rules.value_review_range))
    return (F.when(score < rules.urgent_below, r.ACTION_URGENT)
            .when(status == r.CONTRACT_EXPIRED, r.ACTION_COMMERCIAL)
            .when(status == r.CONTRACT_RENEGOTIATE, r.ACTION_RENEWAL)
            .when(F.col("user_trend") == r.TREND_DECLINING, r.ACTION_ADOPTION)
            .when(worth_review, r.ACTION_PROACTIVE)
            .otherwise(r.ACTION_MONITOR))


def at_risk_next_actions(clean: DataFrame, as_of: datetime | None = None,
                         rules: Rules = STANDARD, ordered: bool = True,
                         layout: str = "window") -> DataFrame:
    """Established accounts of the latest snapshot with score, risk and next action.

    The account's row before the latest one is in the previous snapshot exactly when its
    month is that snapshot's month, so the user trend needs no further join.
    ``ordered=False`` saves the global sort where the order does not matter.  The sort
    samples its input: the exchange before it lets that read shuffled rows, not rerun windows.
    """
    in_previous = F.col("prev_month") == snapshot_months(clean)["previous"]
    rows = scored_latest(clean, rules, layout).withColumn(
        "users_before", F.when(in_previous, F.col("prev_active_users")))
    rows = with_risk_columns(rows, as_of, rules).where(
        F.col("months_since_start") >= rules.risk_onboarding_months)
    rows = (rows.withColumn("recommended_action", recommended_action(rules))
            .select(*VIEW_COLUMNS["at_risk_next_actions"]))
    if not ordered:
        return rows
    # most accounts share a score: the last keys let the sort's ranges split them
    return rows.repartition("team_id").orderBy("overall_health_score", "company_size", "team_id", "company_name")


def onboarding_clients(clean: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """All months of the accounts that are onboarding in the latest snapshot.

    An onboarding account has no row before its first month, so only the newest months
    can hold its rows.  The lower bound follows from the tenure limit and prunes the scan.
    """
    limit = rules.overview_onboarding_months
    latest = snapshot_months(clean)["latest"]
    tenure = months_between_texts(F.col("first_seen_month"), F.col("snapshot_month"), rules)
    # one row per account, of copies that differ the least: none of its months is multiplied
    newest = latest_snapshot(clean).groupBy("team_id", "snapshot_month").agg(
        F.min("salesperson").alias("salesperson"))
    accounts = (
        newest.join(start_date(clean), "team_id")
        .withColumn("months_since_start", tenure)
        .where(F.col("months_since_start") < limit)
        .select("team_id", "salesperson", "months_since_start",
                F.lit(r.STAGE_ONBOARDING).alias("client_stage"),
                below_band(F.col("months_since_start"), r.AGE_BANDS, r.AGE_BAND_LATER)
                .alias("onboarding_age_band"))
    )
    # one month of slack: month texts with days past the month's end run into the next
    oldest = F.date_sub(lenient_day(latest), (limit + 1) * rules.days_per_month + 1)
    recent = clean.where(F.col("snapshot_month") >= oldest.cast("string")).drop("salesperson")
    paid = F.coalesce(F.col("monthly_fee") > rules.paid_users_fee_above, F.lit(False))
    return (recent.join(accounts, "team_id")
            .withColumn("has_paid_users", paid.cast("int"))
            .select(*VIEW_COLUMNS["onboarding_clients"]))
