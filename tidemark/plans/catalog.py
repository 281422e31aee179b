"""The named views over one raw table, for Python callers and for SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.history import Bounds
from tidemark.plans import accounts, health, snapshots, trends
from tidemark.rules import STANDARD, Rules
from tidemark.sources.raw_table import AFTER_LOAD, ledger_number, read_raw_table


# name: (clean rows, as_of, rules, layout) -> frame.  Each view names its own inputs, so
# the order of the entries does not matter.
VIEWS: dict[str, Callable[[DataFrame, datetime | None, Rules, str], DataFrame]] = {
    "clients_clean": lambda c, at, r, lay: c,
    "latest_snapshot": lambda c, at, r, lay: snapshots.latest_snapshot(c),
    "previous_snapshot": lambda c, at, r, lay: snapshots.previous_snapshot(c),
    "growth_summary": lambda c, at, r, lay: snapshots.growth_summary(c),
    "contract_status": lambda c, at, r, lay: snapshots.contract_status(c, at, r),
    "at_risk_watchlist": lambda c, at, r, lay: snapshots.at_risk_watchlist(c, at, r),
    "start_date": lambda c, at, r, lay: snapshots.start_date(c),
    "client_tenure": lambda c, at, r, lay: snapshots.client_tenure(c, r),
    "monthly_usage": lambda c, at, r, lay: trends.monthly_usage(c, lay),
    "engagement_penalty_monthly":
        lambda c, at, r, lay: trends.engagement_penalty_monthly(c, r, lay),
    "user_monthly_penalty": lambda c, at, r, lay: trends.user_monthly_penalty(c, r, lay),
    "user_sharp_decline_penalty":
        lambda c, at, r, lay: trends.user_sharp_decline_penalty(c, r, lay),
    "jobs_posted_penalty_monthly":
        lambda c, at, r, lay: trends.jobs_posted_penalty_monthly(c, r, lay),
    "pricing_exposure_monthly": lambda c, at, r, lay: trends.pricing_exposure_monthly(c),
    "overall_health_score": lambda c, at, r, lay: health.overall_health_score(c, r, lay),
    "health_penalties": lambda c, at, r, lay: health.health_penalties(c, r, layout=lay),
    "health_score_monthly": lambda c, at, r, lay: health.health_score_monthly(c, r, layout=lay),
    "health_narrative_monthly":
        lambda c, at, r, lay: health.health_narrative_monthly(c, r, lay),
    "health_score_monthly_enriched":
        lambda c, at, r, lay: health.health_score_monthly_enriched(c, r, lay),
    "company_overview": lambda c, at, r, lay: accounts.company_overview(c, r, lay),
    "at_risk_next_actions":
        lambda c, at, r, lay: accounts.at_risk_next_actions(c, at, r, layout=lay),
    "onboarding_clients": lambda c, at, r, lay: accounts.onboarding_clients(c, r),
    "engagement_trend": lambda c, at, r, lay: trends.engagement_trend(c, lay),
    "user_trend_monthly": lambda c, at, r, lay: trends.user_trend_monthly(c, layout=lay),
    "clicks_per_user_trend": lambda c, at, r, lay: trends.clicks_per_user_trend(c, layout=lay),
    "user_mom_severity": lambda c, at, r, lay: health.user_mom_severity(c, r, layout=lay),
}


def view(name: str, raw: DataFrame, as_of: datetime | None = None, rules: Rules = STANDARD,
         layout: str | Bounds = "auto") -> DataFrame:
    """One named view over a raw table.  ``as_of`` (default: now) dates the contract rules.

    ``layout="auto"`` cuts the histories that are too long for a task into blocks.  Callers
    that know their histories to be short pass ``window`` and save its count of rows.
    """
    return VIEWS[name](snapshots.clients_clean(raw), as_of, rules, layout)


def register_views(raw: DataFrame, as_of: datetime | None = None, rules: Rules = STANDARD,
                   layout: str | Bounds = "auto") -> None:
    """Make the raw table and all views available to SQL text of this session.

    The views show the rows that ``raw`` was made from; those of ``follow_table`` go with its loads.
    """
    _FOLLOWED.pop(_session(raw.sparkSession), None)
    _register(raw, as_of, rules, layout)


def _register(raw: DataFrame, as_of: datetime | None, rules: Rules, layout: str | Bounds) -> None:
    raw.createOrReplaceTempView("clients_raw")
    clean = snapshots.clients_clean(raw)
    for name, build in VIEWS.items():
        build(clean, as_of, rules, layout).createOrReplaceTempView(name)


@dataclass
class _Followed:
    path: str
    number: int
    as_of: datetime | None
    rules: Rules
    layout: str | Bounds


# By session: the table that its views follow.
_FOLLOWED: dict[str, _Followed] = {}


def _session(spark: SparkSession) -> str:
    return spark._jsparkSession.sessionUUID()


def follow_table(spark: SparkSession, path: str, as_of: datetime | None = None,
                 rules: Rules = STANDARD, layout: str | Bounds = "auto") -> None:
    """Register the views over the raw table at ``path``, and again after each load of it.

    Loads of this session are followed at once, those of others by the next ``sql_to_frame`` (or
    ``refresh_views``). All views change together, so that a query never mixes two states of the table.
    """
    _FOLLOWED[_session(spark)] = _Followed(path, -2, as_of, rules, layout)
    if refresh_views not in AFTER_LOAD:
        AFTER_LOAD.append(refresh_views)
    refresh_views(spark)


def refresh_views(spark: SparkSession) -> None:
    """Bring views that follow a table up to its newest load; without one this does nothing."""
    followed = _FOLLOWED.get(_session(spark))
    if followed is None:
        return
    number = ledger_number(spark, followed.path)
    if number != followed.number:
        _register(read_raw_table(spark, followed.path), followed.as_of, followed.rules, followed.layout)
        followed.number = number


def sql_to_frame(spark: SparkSession, query: str, params: Sequence | None = None) -> DataFrame:
    """Frame of a SQL text with ``?`` markers bound to ``params`` in order."""
    refresh_views(spark)
    return spark.sql(query, args=list(params)) if params else spark.sql(query)
