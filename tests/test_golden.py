"""Hand-made accounts with known results (the cases of FIXTURES.md)."""

from datetime import datetime

import pytest
from conftest import monthly
from pyspark.sql import functions as F

from tidemark.plans.catalog import view
from tidemark.plans.health import health_penalties
from tidemark.plans.snapshots import clients_clean, contract_status, size_of
from tidemark.plans.trends import user_trend_monthly

AS_OF = datetime(2025, 6, 15, 12)


def by_month(frame, *columns):
    return [tuple(row[c] for c in columns) if len(columns) > 1 else row[columns[0]]
            for row in frame.orderBy("snapshot_month").collect()]


def account(users, clicks, jobs):
    return monthly(1, active_users=users, total_clicks_wo_api=clicks, total_jobs=jobs)


GOLDEN = {
    "look-ahead streak": (
        account([100, 90, 80, 70, 60], [1000, 900, 800, 700, 600], [10, 20, 30, 40, 50]),
        [100, 80, 80, 80, 80], "Healthy"),
    "sharp drop at the bound": (
        account([100, 80, 80, 80, 80], [1000, 800, 800, 800, 800], [10, 20, 30, 40, 50]),
        [100, 90, 90, 90, 100], "Healthy"),
    "no users": (account([10, 0, 5], [100, 0, 50], [1, 2, 3]), [100, 90, 90], "Healthy"),
    "jobs ladder": (
        account([10] * 7, [100] * 7, [10, 30, 45, 55, 60, 62, 63]),
        [100, 100, 55, 55, 55, 55, 55], "At Risk"),
    "engagement ladder": (
        account([10] * 5, [100, 90, 80, 70, 60], [10, 20, 30, 40, 50]),
        [100, 60, 60, 60, 60], "Watch"),
    "floor": (
        account([100, 90, 81, 64, 50, 40, 30], [1000, 800, 650, 450, 300, 200, 120],
                [10, 30, 45, 55, 60, 62, 63]),
        [100, 40, 0, 0, 0, 0, 0], "Critical"),
}


@pytest.mark.parametrize("layout", ["window", "blocks"])
@pytest.mark.parametrize("case", GOLDEN)
def test_scores(spark, raw, case, layout):
    rows, scores, last_band = GOLDEN[case]
    scored = by_month(view("overall_health_score", raw(rows), layout=layout),
                      "overall_health_score", "health_band")
    assert [score for score, _ in scored] == scores
    assert scored[-1][1] == last_band


def test_streak_details(spark, raw):
    table = raw(GOLDEN["look-ahead streak"][0])
    penalties = by_month(view("user_monthly_penalty", table), "reset_group",
                         "decline_streak_length", "user_penalty")
    assert penalties == [(1, 4, 20)] * 4
    usage = view("monthly_usage", raw(GOLDEN["jobs ladder"][0]))
    assert by_month(usage, "jobs_posted") == [0, 20, 15, 10, 5, 2, 1]


@pytest.mark.parametrize("users, change, pct, points", [
    ([100, 90], -10, -10.0, 25), ([100, 110], 10, 10.0, 0), ([100, 100], 0, None, 0)])
def test_user_trend_names(spark, raw, users, change, pct, points):
    clean = clients_clean(raw(monthly(1, active_users=users, total_clicks_wo_api=100)))
    assert by_month(user_trend_monthly(clean), "prev_active_users", "users_delta",
                    "users_pct_change")[1] == (change, 100, pct)
    assert health_penalties(clean).first()["user_penalty"] == points
    corrected = by_month(user_trend_monthly(clean, corrected=True), "prev_active_users",
                         "users_delta", "users_pct_change")[1]
    assert corrected == (100, change, change / 100)


def test_unknown_engagement_gives_no_score(spark, raw):
    table = raw(monthly(1, active_users=[10], total_clicks_wo_api=100, total_jobs=1))
    assert view("health_penalties", table).first()["engagement_penalty"] is None
    assert view("health_score_monthly", table).first()["health_score"] is None


CONTRACTS = {
    "06/15/2025": (0, "Expired", "High"),
    "06/10/2025": (-5, "Expired", "High"),
    "07/15/2025": (29, "Renegotiate (0-30 days)", "High"),
    "07/16/2025": (30, "Renewal window (31-90 days)", "High"),
    "09/13/2025": (89, "Renewal window (31-90 days)", "Medium"),
    "09/14/2025": (90, "Active", "Medium"),
    "25/12/2025": (None, "Active", "Low"),
    None: (None, "Active", "Low"),
}


def test_contracts(spark, raw):
    rows = [row for i, end in enumerate(CONTRACTS) for row in monthly(
        i, active_users=[5] * 6, latest_contract_end_date=end)]
    flags = view("at_risk_watchlist", raw(rows), AS_OF).orderBy("team_id").select(
        "days_to_contract_end", "contract_status", "risk_flag").collect()
    assert [tuple(f) for f in flags] == list(CONTRACTS.values())


def test_day_first_contract_dates(spark, raw):
    rows = monthly(1, active_users=[5], latest_contract_end_date="25/12/2025")
    clean = clients_clean(raw(rows), month_first=False)
    assert contract_status(clean, AS_OF).first()["latest_contract_end_date"] == "2025-12-25"


def test_size_bounds(spark):
    sizes = {0: "unknown", None: "unknown", -1: "unknown", 1: "micro", 9: "micro", 10: "small",
             49: "small", 50: "medium", 250: "medium", 251: "large"}
    frame = spark.createDataFrame([(u,) for u in sizes], "u bigint").select(size_of(F.col("u")))
    assert [r[0] for r in frame.collect()] == list(sizes.values())


def test_narrative_joins_what_applies(spark, raw):
    rows = monthly(1, active_users=[100, 90, 80, 70, 50],
                   total_clicks_wo_api=[1000, 800, 600, 400, 200], total_jobs=[1, 9, 12, 13, 13],
                   monthly_fee="9,000")
    assert by_month(view("health_narrative_monthly", raw(rows)), "health_narrative")[-1] == (
        "Engagement has declined for several consecutive months. "
        "Active user numbers have reduced over recent periods. "
        "A significant drop in active users was recorded recently. "
        "Job posting activity has decreased compared to earlier months. "
        "Cost per user is relatively high for the current licence base.")
    quiet = monthly(1, active_users=[10, 10], total_clicks_wo_api=5, total_jobs=1)
    assert by_month(view("health_narrative_monthly", raw(quiet)), "health_narrative") == ["", ""]


def test_onboarding_limits_differ(spark, raw):
    new = monthly(1, "2025-03", active_users=[5] * 4)    # 92 days: 3 months
    newest = monthly(2, "2025-05", active_users=[5] * 2)  # 31 days: 1 month
    old = monthly(3, "2024-06", active_users=[5] * 13)
    table = raw(new + newest + old)
    overview = view("company_overview", table).orderBy("team_id").collect()
    assert [(r["months_since_start"], r["client_stage"]) for r in overview] == [
        (3, "Onboarding"), (1, "Onboarding"), (12, "Established")]
    actions = view("at_risk_next_actions", table, AS_OF).select("team_id").collect()
    assert sorted(r[0] for r in actions) == [1, 3]
    onboarding = view("onboarding_clients", table).groupBy("team_id").agg(
        F.count(F.lit(1)), F.max("onboarding_age_band")).orderBy("team_id").collect()
    assert [tuple(r) for r in onboarding] == [(1, 4, "Month 3–6"), (2, 2, "Month 1–3")]


def test_test_accounts_are_left_out(spark, raw):
    rows = [{**r, "is_test": t} for t in (None, 0, 1, 2)
            for r in monthly(10 + (t or 0), active_users=[1])]
    assert view("clients_clean", raw(rows)).count() == 2


def test_single_month_has_no_previous(spark, raw):
    table = raw(monthly(1, active_users=[5]))
    assert view("previous_snapshot", table).count() == 0
    assert view("growth_summary", table).first()["user_trend"] == "new"


def test_rows_without_account_id(spark, raw):
    """They match nothing: full score, no penalties, no overview score, no action."""
    rows = monthly(1, active_users=[9, 8, 7, 6], total_clicks_wo_api=5, total_jobs=1)
    rows += [{**r, "team_id": None, "company_name": "nameless"} for r in monthly(
        0, active_users=[90, 80, 70, 20], total_clicks_wo_api=500, total_jobs=1,
        monthly_fee="500")]
    for layout in ("window", "blocks"):
        def nameless(name):
            return by_month(view(name, raw(rows), AS_OF, layout=layout).where(
                "company_name = 'nameless'").withColumn("snapshot_month", F.lit("")),
                *wanted[name])
        wanted = {
            "overall_health_score": ("overall_health_score", "user_penalty",
                                     "sharp_decline_penalty", "fee_per_user"),
            "health_score_monthly_enriched": ("overall_health_score", "health_narrative"),
            "company_overview": ("months_since_start", "overall_health_score"),
            "health_penalties": ("engagement_penalty", "user_penalty"),
            "at_risk_watchlist": ("contract_status", "risk_flag"),
            "at_risk_next_actions": ("team_id", "risk_flag"),
        }
        assert nameless("overall_health_score") == [(100, None, None, None)] * 4
        assert nameless("health_score_monthly_enriched") == [(100, None)] * 4
        assert nameless("company_overview") == [(None, None)]
        assert nameless("health_penalties") == [(None, 0)]
        assert nameless("at_risk_watchlist") == [(None, "Low")]
        assert nameless("at_risk_next_actions") == []
