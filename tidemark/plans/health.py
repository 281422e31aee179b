"""Penalties to score, band and narrative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules as r
from tidemark.functions.numbers import (
    at_least_band, at_most_band, points_by_length, round_half_away, strict_greatest,
    strict_least)
from tidemark.operators.history import account_timeline, settled_layout
from tidemark.plans.snapshots import latest_snapshot, snapshot_months
from tidemark.plans.trends import (
    has_pricing, is_sharp_decline, price_per_user, user_trend_columns)
from tidemark.rules import STANDARD, Rules
from tidemark.schema import VIEW_COLUMNS


def _timeline(clean: DataFrame, layout: str) -> DataFrame:
    """The account timeline; rows without an account id stay outside it.  They carry no
    penalty, so nothing of theirs is measured along months."""
    known = F.col("team_id").isNotNull()
    return account_timeline(clean.where(known), settled_layout(clean, layout)).unionByName(
        clean.where(~known), allowMissingColumns=True)


def scored_history(clean: DataFrame, rules: Rules = STANDARD,
                   layout: str = "window") -> DataFrame:
    """Every clean row with its penalties, score, band and narrative, in one shuffle.

    A streak counts whole: a month's score can still change while its streak goes on.
    Price per user is today's: that of the account's row in the latest snapshot.
    """
    return scored_timeline(_timeline(clean, layout), snapshot_months(clean)["latest"], rules)


def scored_timeline(timeline: DataFrame, latest: Column, rules: Rules = STANDARD) -> DataFrame:
    """``scored_history`` of an account timeline, as the one that ``sources.timeline_table`` keeps."""
    timeline = timeline.withColumn("in_latest", F.col("last_month") == latest)
    return _scored(
        timeline, "streak",
        fee=F.when(F.col("in_latest"), F.col("last_monthly_fee")),
        users=F.when(F.col("in_latest"), F.col("last_active_users")), rules=rules)


# What the latest row of an account needs from the months before it.
_LATEST_SIGNALS = [
    "first_seen_month", "prev_month", "prev_active_users", "engagement_delta",
    "worst_3m_pct_change", "engagement_streak_so_far", "user_streak_so_far",
    "jobs_streak_so_far"]


def latest_with_signals(clean: DataFrame, layout: str = "window") -> DataFrame:
    """The latest snapshot, each account with its signals of that month.

    Only the few numbers behind the signals go through the shuffle of the full history;
    names, fees and dates come from a scan of the one month and join on the account.  Copies
    of an account's latest row all get the signals of the last of them, so none is multiplied.
    """
    history = account_timeline(clean.where(F.col("team_id").isNotNull()), settled_layout(clean, layout))
    signals = (history.where(F.col("snapshot_month") == snapshot_months(clean)["latest"])
               .groupBy("team_id").agg(
                   *[F.max_by(c, "position").alias(c) for c in _LATEST_SIGNALS]))
    return latest_snapshot(clean).join(signals, "team_id", "left")


def scored_latest(clean: DataFrame, rules: Rules = STANDARD,
                  layout: str = "window") -> DataFrame:
    """The latest snapshot's rows of ``scored_history``, with size and signals.

    The latest row ends its account's history, so the streak up to it is the whole one
    and its own fee is today's: neither needs a look ahead.
    """
    return _scored(latest_with_signals(clean, layout), "streak_so_far",
                   fee=F.col("monthly_fee"), users=F.col("active_users"), rules=rules)


def _scored(timeline: DataFrame, streak: str, fee: Column, users: Column,
            rules: Rules) -> DataFrame:
    known = F.col("team_id").isNotNull()  # rows without an account id carry no penalty

    def points(signal: str, table: tuple[int, ...]) -> Column:
        return F.when(known, points_by_length(F.col(f"{signal}_{streak}"), table))

    penalties = ["engagement_penalty", "user_penalty", "sharp_decline_penalty",
                 "jobs_posted_penalty"]
    lost = sum((F.coalesce(F.col(p), F.lit(0)) for p in penalties[1:]),
               F.coalesce(F.col(penalties[0]), F.lit(0)))
    return (
        timeline
        .withColumns({
            "engagement_streak_counted": F.when(known, F.col(f"engagement_{streak}")),
            "engagement_penalty": points("engagement", rules.engagement_points),
            "user_penalty": points("user", rules.user_points),
            "jobs_posted_penalty": points("jobs", rules.jobs_points),
            "sharp_decline_penalty": F.when(
                known, is_sharp_decline(rules) * rules.sharp_decline_points),
            "fee_per_user": F.when(known, price_per_user(fee, users)),
            "has_pricing_data": F.when(known, has_pricing(fee)),
        })
        .withColumn("overall_health_score", F.greatest(F.lit(100) - lost, F.lit(0)))
        .withColumns({
            "health_band": at_least_band(
                F.col("overall_health_score"), rules.band_bounds, rules.band_lowest),
            "health_narrative": narrative(rules),
        })
    )


def narrative(rules: Rules = STANDARD) -> Column:
    """The sentences that apply, joined by single blanks; empty when none does."""
    streak, price = F.col("engagement_streak_counted"), F.col("fee_per_user")
    priced = F.col("has_pricing_data") == 1
    sentences = [
        F.when(streak >= rules.long_engagement_streak, r.SAY_ENGAGEMENT_LONG)
        .when(streak >= rules.short_engagement_streak, r.SAY_ENGAGEMENT_SHORT),
        F.when(F.col("user_penalty") > 0, r.SAY_USERS),
        F.when(F.col("sharp_decline_penalty") > 0, r.SAY_SHARP),
        F.when(F.col("jobs_posted_penalty") > 0, r.SAY_JOBS),
        F.when(priced & (price > rules.fee_per_user_high), r.SAY_PRICE_HIGH)
        .when(priced & (price < rules.fee_per_user_low), r.SAY_PRICE_LOW),
    ]
    return F.concat_ws(" ", *sentences)


def overall_health_score(clean: DataFrame, rules: Rules = STANDARD,
                         layout: str = "window") -> DataFrame:
    return scored_history(clean, rules, layout).select(*VIEW_COLUMNS["overall_health_score"])


def health_narrative_monthly(clean: DataFrame, rules: Rules = STANDARD,
                             layout: str = "window") -> DataFrame:
    return scored_history(clean, rules, layout).select(
        *VIEW_COLUMNS["health_narrative_monthly"])


def health_score_monthly_enriched(clean: DataFrame, rules: Rules = STANDARD,
                                  layout: str = "window") -> DataFrame:
    known = F.col("team_id").isNotNull()
    return (scored_history(clean, rules, layout)
            .withColumn("health_narrative", F.when(known, F.col("health_narrative")))
            .select(*VIEW_COLUMNS["health_score_monthly_enriched"]))


def health_penalties(clean: DataFrame, rules: Rules = STANDARD, corrected: bool = False,
                     layout: str = "window") -> DataFrame:
    """Two-signal penalties of the latest snapshot."""
    delta = F.col("engagement_delta")
    engagement = F.when(delta >= rules.engagement_delta_floor, F.lit(0.0)).otherwise(
        strict_least(F.lit(rules.engagement_delta_cap), F.abs(delta) * 100 * 1.2))
    users = at_most_band(F.col("users_pct_change"), rules.user_change_points, 0)
    return (
        latest_with_signals(clean, layout)
        .withColumns(user_trend_columns(corrected))
        .withColumns({"engagement_penalty": engagement, "user_penalty": users})
        .select(*VIEW_COLUMNS["health_penalties"])
    )


def health_score_monthly(clean: DataFrame, rules: Rules = STANDARD, corrected: bool = False,
                         layout: str = "window") -> DataFrame:
    """Two-signal score; empty where the engagement change is unknown."""
    left = F.lit(100) - F.col("engagement_penalty") - F.col("user_penalty")
    return (health_penalties(clean, rules, corrected, layout)
            .withColumn("health_score", strict_greatest(F.lit(0.0), round_half_away(left, 0)))
            .select(*VIEW_COLUMNS["health_score_monthly"]))


def user_mom_severity(clean: DataFrame, rules: Rules = STANDARD, corrected: bool = False,
                      layout: str = "window") -> DataFrame:
    """The two-signal penalties under their earlier column name."""
    return health_penalties(clean, rules, corrected, layout).withColumnRenamed(
        "user_penalty", "user_mom_decline")
