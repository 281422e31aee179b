"""Monthly usage, trends and penalties: projections of the account timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import points_by_length, ratio, round_half_away
from tidemark.operators.history import account_timeline
from tidemark.plans.snapshots import latest_snapshot, size_of
from tidemark.rules import STANDARD, Rules
from tidemark.schema import VIEW_COLUMNS


def monthly_usage(clean: DataFrame, layout: str = "window") -> DataFrame:
    return account_timeline(clean, layout).select(*VIEW_COLUMNS["monthly_usage"])


def engagement_penalty_monthly(clean: DataFrame, rules: Rules = STANDARD,
                               layout: str = "window") -> DataFrame:
    """Declining months only; a streak's points go to every month of it."""
    streak = F.col("engagement_streak")
    return account_timeline(clean, layout).where("engagement_declining").select(
        "team_id", "snapshot_month",
        streak.alias("decline_streak_length"),
        points_by_length(streak, rules.engagement_points).alias("engagement_penalty"))


def user_monthly_penalty(clean: DataFrame, rules: Rules = STANDARD,
                         layout: str = "window") -> DataFrame:
    streak = F.col("user_streak")
    return account_timeline(clean, layout).where("user_declining").select(
        "team_id", "company_name", "snapshot_month", "active_users", "prev_active_users",
        "user_pct_change",
        F.col("user_declining").cast("int").alias("are_users_declining"),
        F.col("user_breaks").alias("reset_group"),
        streak.alias("decline_streak_length"),
        points_by_length(streak, rules.user_points).alias("user_penalty"))


def jobs_posted_penalty_monthly(clean: DataFrame, rules: Rules = STANDARD,
                                layout: str = "window") -> DataFrame:
    streak = F.col("jobs_streak")
    return account_timeline(clean, layout).where("jobs_declining").select(
        "team_id", "snapshot_month",
        streak.alias("decline_streak_length"),
        points_by_length(streak, rules.jobs_points).alias("jobs_posted_penalty"))


def is_sharp_decline(rules: Rules) -> Column:
    worst = F.col("worst_3m_pct_change")
    return F.coalesce(worst <= rules.sharp_decline_pct, F.lit(False)).cast("int")


def user_sharp_decline_penalty(clean: DataFrame, rules: Rules = STANDARD,
                               layout: str = "window") -> DataFrame:
    sharp = is_sharp_decline(rules)
    return account_timeline(clean, layout).select(
        "team_id", "company_name", "snapshot_month", "active_users", "prev_active_users",
        "user_pct_change", "worst_3m_pct_change",
        sharp.alias("is_user_sharp_decline"),
        (sharp * rules.sharp_decline_points).alias("sharp_decline_penalty"))


def price_per_user(fee: Column, users: Column) -> Column:
    return round_half_away(ratio(fee, users), 2)


def has_pricing(fee: Column) -> Column:
    return F.coalesce(fee != 0, F.lit(False)).cast("int")


def pricing_exposure_monthly(clean: DataFrame) -> DataFrame:
    """Today's fee and users of an account, on each of its months."""
    today = latest_snapshot(clean).select("team_id", "monthly_fee", "active_users",
                                          "company_size")
    fee, users = F.col("monthly_fee"), F.col("active_users")
    return (
        clean.select("team_id", "company_name", "snapshot_month")
        .join(today, "team_id", "left")
        .select("team_id", "company_name", "snapshot_month", "monthly_fee", "active_users",
                "company_size", price_per_user(fee, users).alias("fee_per_user"),
                has_pricing(fee).alias("has_pricing_data"))
    )


def engagement_trend(clean: DataFrame, layout: str = "window") -> DataFrame:
    return account_timeline(clean, layout).select(*VIEW_COLUMNS["engagement_trend"])


def user_trend_columns(corrected: bool = False) -> dict[str, Column]:
    """``prev_active_users`` of this view is the change since the month before, and the
    other two columns follow from that.  ``corrected`` gives what the names say."""
    users, before = F.col("active_users"), F.col("prev_active_users")
    previous = before if corrected else users - before
    delta = users - previous
    return {
        "prev_active_users": previous,
        "users_delta": delta,
        "users_pct_change": round_half_away(ratio(delta, previous), 3),
    }


def user_trend_monthly(clean: DataFrame, corrected: bool = False,
                       layout: str = "window") -> DataFrame:
    return (account_timeline(clean, layout)
            .withColumns(user_trend_columns(corrected))
            .select(*VIEW_COLUMNS["user_trend_monthly"]))


def clicks_per_user_trend(clean: DataFrame, ordered: bool = True,
                          layout: str = "window") -> DataFrame:
    rows = account_timeline(clean, layout).select(
        "company_name", "team_id", "snapshot_month", "clicks_per_user", "prev_clicks_per_user",
        (F.col("clicks_per_user") - F.col("prev_clicks_per_user"))
        .alias("clicks_per_user_delta"),
        round_half_away(F.col("clicks_per_user_change") * 100, 2).alias("clicks_per_user_pct_change"))
    if not ordered:
        return rows
    # the exchange lets the sort sample shuffled rows, not rerun the windows; names may repeat
    return rows.repartition("team_id", "snapshot_month").orderBy("company_name", "snapshot_month", "team_id")
