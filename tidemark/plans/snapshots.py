"""Clean rows, the two newest snapshots, and what follows from them per account."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules as r
from tidemark.functions.dates import (
    MICROS_PER_DAY, iso_from_parts, lenient_day, micros_until, whole_days)
from tidemark.functions.numbers import leading_number, ratio, round_half_away
from tidemark.operators.facts import facts_of, with_facts
from tidemark.rules import STANDARD, Rules
from tidemark.schema import CLEAN_COLUMNS, VIEW_COLUMNS


def clients_clean(raw: DataFrame, month_first: bool = True) -> DataFrame:
    """Typed rows without test accounts.

    Contract dates are read month first; ``month_first=False`` reads them day first.
    """
    month_at, day_at = (1, 4) if month_first else (4, 1)
    without_commas = F.replace(F.col("monthly_fee").cast("string"), F.lit(","), F.lit(""))
    end = iso_from_parts(F.col("latest_contract_end_date"), month_at, day_at, year_at=7)
    rows = (
        raw.where(F.coalesce(F.col("is_test"), F.lit(0)) == 0)
        .withColumns({"monthly_fee": without_commas, "latest_contract_end_date": end})
        .withColumn("monthly_fee", leading_number(F.col("monthly_fee")))
        .select(*CLEAN_COLUMNS)
    )
    return with_facts(rows, facts_of(raw))


def snapshot_months(clean: DataFrame) -> Column:
    """The two newest months of the table, a struct with fields ``latest`` and ``previous`` (NULL
    when there is only one month): from the table's ledger, or else a scalar subquery.

    On a table partitioned by month, a filter on one of them prunes partitions.
    """
    facts = facts_of(clean)
    if facts is not None:
        return F.struct(F.lit(facts.latest).cast("string").alias("latest"), F.lit(facts.previous).cast("string").alias("previous"))
    newest_two = (clean.select("snapshot_month").where(F.col("snapshot_month").isNotNull())
                  .distinct().orderBy(F.desc("snapshot_month")).limit(2))
    ends = newest_two.agg(
        F.max("snapshot_month").alias("latest"),
        F.when(F.count(F.lit(1)) == 2, F.min("snapshot_month")).alias("previous"))
    return ends.select(F.struct("latest", "previous")).scalar()


def size_of(users: Column) -> Column:
    return (F.when(users.between(1, 9), r.SIZE_MICRO)
            .when(users.between(10, 49), r.SIZE_SMALL)
            .when(users.between(50, 250), r.SIZE_MEDIUM)
            .when(users > 250, r.SIZE_LARGE)
            .otherwise(r.SIZE_UNKNOWN))


def latest_snapshot(clean: DataFrame) -> DataFrame:
    latest = clean.where(F.col("snapshot_month") == snapshot_months(clean)["latest"])
    return latest.withColumn("company_size", size_of(F.col("active_users")))


def previous_snapshot(clean: DataFrame) -> DataFrame:
    return clean.where(F.col("snapshot_month") == snapshot_months(clean)["previous"])


def user_trend_of(now: Column, before: Column) -> Column:
    return (F.when(before.isNull(), r.TREND_NEW)
            .when(now > before, r.TREND_GROWING)
            .when(now < before, r.TREND_SHRINKING)
            .otherwise(r.TREND_FLAT))


# measure in the growth summary: source column
_GROWTH = {"users": "active_users", "clicks": "total_clicks", "fee": "monthly_fee",
           "jobs": "total_jobs"}


def growth_summary(clean: DataFrame) -> DataFrame:
    """Latest against previous snapshot: two pruned scans joined on the account."""
    now = latest_snapshot(clean).select(
        "team_id", "company_name",
        *[F.col(c).alias(f"{m}_current") for m, c in _GROWTH.items()])
    before = previous_snapshot(clean).select(
        "team_id", *[F.col(c).alias(f"{m}_previous") for m, c in _GROWTH.items()])
    return (
        now.join(before, "team_id", "left")
        .withColumns({f"{m}_change": F.col(f"{m}_current") - F.col(f"{m}_previous")
                      for m in _GROWTH})
        .withColumn("user_trend", user_trend_of(F.col("users_current"), F.col("users_previous")))
        .select(*VIEW_COLUMNS["growth_summary"])
    )


def days_to_end(end_text: Column, as_of: datetime | None) -> Column:
    return whole_days(micros_until(lenient_day(end_text), as_of))


def contract_status_of(end_text: Column, as_of: datetime | None,
                       rules: Rules = STANDARD) -> Column:
    """Status by the exact time left, so a contract ending today has expired."""
    left = micros_until(lenient_day(end_text), as_of)
    return (F.when(left < 0, r.CONTRACT_EXPIRED)
            .when(left <= rules.renegotiate_days * MICROS_PER_DAY, r.CONTRACT_RENEGOTIATE)
            .when(left <= rules.renewal_days * MICROS_PER_DAY, r.CONTRACT_RENEWAL)
            .otherwise(r.CONTRACT_ACTIVE))


def contract_status(clean: DataFrame, as_of: datetime | None = None,
                    rules: Rules = STANDARD) -> DataFrame:
    end = F.col("latest_contract_end_date")
    return latest_snapshot(clean).select(
        "team_id", "company_name", "latest_contract_end_date",
        days_to_end(end, as_of).alias("days_to_contract_end"),
        contract_status_of(end, as_of, rules).alias("contract_status"))


def start_date(clean: DataFrame) -> DataFrame:
    return clean.groupBy("team_id").agg(F.min("snapshot_month").alias("first_seen_month"))


def months_between_texts(first: Column, last: Column, rules: Rules = STANDARD) -> Column:
    """Whole months of fixed length between two month texts."""
    days = F.datediff(lenient_day(last), lenient_day(first))
    return (days / rules.days_per_month).cast("int")


def client_tenure(clean: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    tenure = months_between_texts(F.col("first_seen_month"), F.col("snapshot_month"), rules)
    return (latest_snapshot(clean).join(start_date(clean), "team_id")
            .withColumn("months_since_start", tenure)
            .select(*VIEW_COLUMNS["client_tenure"]))


def stage_of(months: Column, limit: int) -> Column:
    return F.when(months < limit, r.STAGE_ONBOARDING).otherwise(r.STAGE_ESTABLISHED)


def risk_flag_of(months: Column, days: Column, trend: Column, rules: Rules = STANDARD) -> Column:
    in_renewal = days <= rules.renewal_days
    return (F.when(months < rules.risk_onboarding_months, r.RISK_MONITOR)
            .when(days <= rules.renegotiate_days, r.RISK_HIGH)
            .when(in_renewal & (trend == r.TREND_DECLINING), r.RISK_HIGH)
            .when(in_renewal, r.RISK_MEDIUM)
            .otherwise(r.RISK_LOW))


def with_risk_columns(rows: DataFrame, as_of: datetime | None,
                      rules: Rules = STANDARD) -> DataFrame:
    """Contract, trend, tenure and risk of latest rows.

    Needs ``users_before`` (the account's users in the previous snapshot) and
    ``first_seen_month``.  Rows without an account id match nothing, so theirs stay empty.
    """
    known = F.col("team_id").isNotNull()
    end = F.when(known, F.col("latest_contract_end_date"))
    return (
        rows
        .withColumns({
            "latest_contract_end_date": end,
            "days_to_contract_end": F.when(known, days_to_end(end, as_of)),
            "contract_status": F.when(known, contract_status_of(end, as_of, rules)),
            "user_trend": F.when(
                known, user_trend_of(F.col("active_users"), F.col("users_before"))),
            "months_since_start": F.when(known, months_between_texts(
                F.col("first_seen_month"), F.col("snapshot_month"), rules)),
        })
        .withColumns({
            "fee_per_user": round_half_away(ratio(F.col("monthly_fee"), F.col("active_users")), 2),
            "client_stage": stage_of(F.col("months_since_start"), rules.risk_onboarding_months),
            "risk_flag": risk_flag_of(F.col("months_since_start"), F.col("days_to_contract_end"),
                                      F.col("user_trend"), rules),
        })
    )


def at_risk_watchlist(clean: DataFrame, as_of: datetime | None = None,
                      rules: Rules = STANDARD) -> DataFrame:
    before = previous_snapshot(clean).select(
        "team_id", F.col("active_users").alias("users_before"))
    rows = (latest_snapshot(clean)
            .join(before, "team_id", "left")
            .join(start_date(clean), "team_id", "left"))
    return with_risk_columns(rows, as_of, rules).select(*VIEW_COLUMNS["at_risk_watchlist"])
