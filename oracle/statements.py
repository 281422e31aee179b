"""One statement per query key."""

from __future__ import annotations

from oracle.columns import MISSING_TEXTS, RAW_COLUMNS, VIEW_COLUMNS
from oracle.views import over_hot_views, over_views, rounded


def _columns(view: str, **renamed: str) -> str:
    return ", ".join(f"{renamed[c]} as {c}" if c in renamed else c for c in VIEW_COLUMNS[view])


def _view(view: str, relation: str, where: str = "", **renamed: str) -> str:
    return over_views(f"select {_columns(view, **renamed)} from {relation} {where}")


VIEWS = {
    "clients_clean": _view("clients_clean", "clean"),
    "latest_snapshot": _view("latest_snapshot", "latest"),
    "previous_snapshot": _view("previous_snapshot", "previous"),
    "growth_summary": _view("growth_summary", "growth"),
    "contract_status": _view("contract_status", "contract"),
    "at_risk_watchlist": _view("at_risk_watchlist", "watchlist"),
    "start_date": _view("start_date", "started"),
    "client_tenure": _view("client_tenure", "tenure"),
    "monthly_usage": _view("monthly_usage", "usage"),
    "engagement_penalty_monthly": _view(
        "engagement_penalty_monthly", "engagement_points",
        decline_streak_length="streak", engagement_penalty="penalty"),
    "user_monthly_penalty": _view(
        "user_monthly_penalty", "user_points", prev_active_users="users_1",
        user_pct_change="change", are_users_declining="1", reset_group="breaks_before",
        decline_streak_length="streak", user_penalty="penalty"),
    "user_sharp_decline_penalty": _view(
        "user_sharp_decline_penalty", "sharp_points", prev_active_users="users_1",
        user_pct_change="change", worst_3m_pct_change="worst",
        is_user_sharp_decline="is_sharp", sharp_decline_penalty="is_sharp * 10"),
    "jobs_posted_penalty_monthly": _view(
        "jobs_posted_penalty_monthly", "jobs_points",
        decline_streak_length="streak", jobs_posted_penalty="penalty"),
    "pricing_exposure_monthly": _view("pricing_exposure_monthly", "pricing"),
    "overall_health_score": _view("overall_health_score", "scored"),
    "health_penalties": _view("health_penalties", "simple_penalties"),
    "health_score_monthly": _view("health_score_monthly", "simple_score"),
    "health_narrative_monthly": _view("health_narrative_monthly", "narrated"),
    "health_score_monthly_enriched": over_views(
        "select s.team_id, s.company_name, s.snapshot_month, s.overall_health_score, "
        "s.health_band, n.health_narrative from scored s "
        "left join narrated n using (team_id, snapshot_month)"),
    "company_overview": _view("company_overview", "overview"),
    "at_risk_next_actions": _view("at_risk_next_actions", "actions"),
    "onboarding_clients": _view("onboarding_clients", "onboarding"),
    "engagement_trend": _view("engagement_trend", "engagement"),
    "user_trend_monthly": _view("user_trend_monthly", "user_trend"),
    "clicks_per_user_trend": over_views(
        "select company_name, team_id, snapshot_month, cpu as clicks_per_user, "
        "cpu_1 as prev_clicks_per_user, cpu - cpu_1 as clicks_per_user_delta, "
        + rounded("(cpu - cpu_1) / nullif(cpu_1, 0) * 100", 2)
        + " as clicks_per_user_pct_change from stepped"),
    "user_mom_severity": _view("user_mom_severity", "simple_penalties",
                               user_mom_decline="user_penalty"),
}

_REVIEW = ", ".join(VIEW_COLUMNS["at_risk_next_actions"])
_AT_RISK = ("select company_name, overall_health_score, health_narrative, company_size, "
            "monthly_fee, salesperson from actions where overall_health_score <= 40")
_COMPANIES = ("select distinct team_id, company_name, company_size, region, monthly_fee, "
              "client_stage, overall_health_score, salesperson from overview")
_USAGE = ("select u.team_id, u.snapshot_month, u.total_clicks_wo_api, u.active_users, "
          "u.jobs_posted, u.active_coddlers, s.overall_health_score from usage u "
          "left join scored s using (team_id, snapshot_month)")


def _newest(relation: str, columns: str, over=over_views) -> str:
    return over(
        f"select {columns} from {relation} qualify row_number() over "
        "(partition by team_id order by snapshot_month desc) = 1")


SERVING = {
    "load_companies": over_views(_COMPANIES),
    "load_monthly_usage": over_views(_USAGE),
    "load_risk_flag": over_views(
        "select team_id, risk_flag, contract_status, days_to_contract_end, "
        "latest_contract_end_date from watchlist"),
    "load_at_risk_clients": over_views(_AT_RISK),
    "load_clients_to_review": over_views(f"select {_REVIEW} from actions"),
    "load_health_scores": over_views(
        "select team_id, snapshot_month, health_score from simple_score"),
    "load_latest_health_summary": _newest(
        "scored join narrated using (team_id, snapshot_month)",
        "team_id, snapshot_month, overall_health_score, health_band, health_narrative"),
    "load_onboarding_clients": _newest(
        "onboarding", "team_id, snapshot_month, onboarding_age_band"),
}

_PICKED_REVIEW = (
    "health_band in ('Critical', 'Healthy') and company_size in ('medium', 'large') "
    "and salesperson in ('Rep 1', 'Rep 2', 'Rep 5') and region in ('AFRICA', 'AMERICA')")


def _options(relation: str, *dimensions: str) -> str:
    return over_views(" union all ".join(
        f"select distinct '{d}' as dimension, {d} as option from ({relation}) "
        + ("where salesperson is not null" if d == "salesperson" else "") for d in dimensions))


def _bands(where: str) -> str:
    return over_views("select " + ", ".join(
        f"count(*) filter (health_band = '{band}') as {name}"
        for band, name in [("Critical", "critical"), ("At Risk", "at_risk"),
                           ("Watch", "watch"), ("Healthy", "healthy")])
        + f" from actions {where}")


_LAST_USERS = ("select team_id, active_users as latest_users from usage qualify row_number() "
               "over (partition by team_id order by snapshot_month desc) = 1")

DASHBOARD = {
    "critical_count": over_views(f"select count(*) as critical_count from ({_AT_RISK})"),
    "onboarding_count": over_views(
        "select count(*) as onboarding_count from overview where client_stage = 'Onboarding'"),
    "growth_opportunity_pct": over_views(
        # the formatter rounds the stored double exactly, ties to even
        "select cast(format('{:.1f}', count(*) filter (overall_health_score > 70) "
        "/ cast(nullif(count(*), 0) as double) * 100) as double) as growth_opportunity_pct "
        "from overview"),
    "latest_month": over_views("select max(snapshot_month) as latest_month from usage"),
    "at_risk_sorted": over_views(_AT_RISK),
    "filter_at_risk": over_views(
        f"select * from ({_AT_RISK}) where company_size in ('medium', 'large') "
        "and salesperson in ('Rep 1', 'Rep 2', 'Rep 3', 'Rep 5')"),
    "filter_clients": over_views(
        f"select * from ({_COMPANIES}) where company_size in ('medium', 'small') "
        "and salesperson in ('Rep 0', 'Rep 4', 'Rep 6') "
        "and region in ('AFRICA', 'ASIA', 'EUROPE')"),
    "filter_review": over_views(f"select {_REVIEW} from actions where {_PICKED_REVIEW}"),
    "filter_default_selection": over_views(
        f"select {_REVIEW} from actions where salesperson is not null"),
    "filter_options_at_risk": _options(_AT_RISK, "company_size", "salesperson"),
    "filter_options_clients": _options(_COMPANIES, "company_size", "salesperson", "region"),
    "filter_options": _options(
        "select * from actions", "health_band", "company_size", "salesperson", "region"),
    "band_counts": _bands(""),
    "band_counts_filtered": _bands(f"where {_PICKED_REVIEW}"),
    "client_lookup": over_views(
        "select company_name, min(team_id) as team_id from overview group by company_name"),
    "prepare_time_series": over_views(
        f"select u.* replace (cast(snapshot_month as date) as snapshot_month) from ({_USAGE}) u"),
    "usage_series": over_views(" union all ".join(
        f"select team_id, snapshot_month, '{c}' as series, cast({c} as bigint) as value "
        f"from ({_USAGE})" for c in [
            "total_clicks_wo_api", "jobs_posted", "active_users", "active_coddlers",
            "overall_health_score"])),
    "fee_per_latest_user": over_views(
        "select team_id, round_even(monthly_fee / nullif(latest_users, 0) * 100, 0) / 100 "
        f"as fee_per_user from overview join ({_LAST_USERS}) using (team_id)"),
    "latest_users": over_views(_LAST_USERS),
    "fee_display": over_views(
        "select team_id, case when monthly_fee is null then 'Unknown' else "
        "(case when region = 'UK' then '£' else '$' end) "
        "|| format('{:,}', cast(trunc(monthly_fee) as bigint)) end as fee_display from actions"),
    "days_display": over_views(
        "select team_id, coalesce(cast(days_to_contract_end as varchar), "
        "'Unknown. Please check') as days_display from actions"),
    "size_display": over_views(
        "select team_id, upper(company_size[1]) || lower(company_size[2:]) as size_display "
        "from actions"),
    "review_table": over_views(
        "select company_name, salesperson, company_size, region, monthly_fee, "
        "overall_health_score, health_band, recommended_action, contract_status, "
        "days_to_contract_end from actions"),
}

# Field texts that count as missing when they come from a file.
_MISSING = ", ".join(f"'{t}'" for t in MISSING_TEXTS)
_FROM_FILES = (
    "company_name, team_id, total_clicks, total_clicks_wo_api, non_jobs_clicks, "
    "view_candidates, active_coddlers, "
    f"case when monthly_fee not in ({_MISSING}) then monthly_fee end as monthly_fee, "
    "number_candidate_emails, number_contact_emails, salesperson, latest_contract_end_date, "
    "active_harvester_accounts, active_users, total_resumes, total_jobs, hires_in_past_year")
_PATH = "'/drop/' || lower(region) || '/' || substr(snapshot_month, 1, 7) || '.csv'"
_SOURCE = "lower(region) || '/' || substr(snapshot_month, 1, 7) || '.csv'"
_LOADED = (
    f"select {_FROM_FILES}, cast(null as integer) as is_test, region, snapshot_month, "
    f"{_SOURCE} as source_file, '2001-10-15' as load_date, "
    "cast(null as varchar) as monthly_fee_currency from raw")

INGEST = {
    "fixture_panel": over_views(f"select {', '.join(RAW_COLUMNS)} from raw"),
    "ingest_scan": over_views(f"select {_FROM_FILES} from raw"),
    "ingest_rename": over_views(f"select {_FROM_FILES} from raw"),
    "ingest_region": over_views(
        f"select cast(team_id as varchar) as team_id, {_PATH} as path, region from raw"),
    "ingest_month": over_views(
        f"select cast(team_id as varchar) as team_id, {_PATH} as path, snapshot_month from raw"),
    "ingest_lineage": over_views(
        f"select cast(team_id as varchar) as team_id, {_PATH} as path, {_SOURCE} as source_file, "
        "'2001-10-15' as load_date, cast(null as integer) as is_test from raw"),
    "ingest_new_files": over_views(
        "select snapshot_month, region, min('/again/' || lower(region) || '/' "
        "|| substr(snapshot_month, 1, 7) || '.csv') as path from raw "
        "where region <> 'AFRICA' group by 1, 2"),
    "ingest_idempotent": over_views(
        f"select * from ({_LOADED}) b where not exists (select 1 from ({_LOADED}) t "
        "where t.region in ('ASIA', 'EUROPE') and t.region = b.region "
        "and t.snapshot_month = b.snapshot_month)"),
    "ingest_load": over_views(_LOADED),
    "ingest_line_breaks": over_views(
        "select * replace (company_name || chr(10) || '\"new\", line' || chr(10) "
        f"|| cast(total_clicks as varchar) as company_name) from ({_LOADED})"),
    "ingest_replace": over_views(
        "select * replace (case when region in ('ASIA', 'EUROPE') then load_date "
        f"else '2001-01-01' end as load_date) from ({_LOADED})"),
    "ingest_append": over_views(_LOADED),
    "ingest_report": over_views(
        f"select source_file, count(*) as rows from ({_LOADED}) group by source_file"),
    "raw_table": over_views(_LOADED),
    "sql_to_frame": over_views(
        "select company_name, overall_health_score, health_band, recommended_action "
        "from actions where overall_health_score <= 60 and region <> 'ASIA'"),
}

LONG_HISTORY = {f"{name}_blocks": VIEWS[name] for name in [
    "user_monthly_penalty", "overall_health_score", "health_score_monthly_enriched",
    "engagement_trend", "at_risk_next_actions"]}



def _hot(name: str) -> str:
    normal = VIEWS[name] if name in VIEWS else SERVING[name]
    return over_hot_views(normal.removeprefix(over_views("")))


HOT = {f"{name}_hot": _hot(name) for name in [
    "monthly_usage", "user_monthly_penalty", "user_sharp_decline_penalty", "overall_health_score",
    "health_score_monthly_enriched", "at_risk_next_actions"]} | {
    "load_monthly_usage_hot": over_hot_views(f"select * from ({_USAGE}) where team_id is not null"),
    "load_latest_health_summary_hot": _newest(
        "(select * from scored where team_id is not null) join narrated using (team_id, snapshot_month)",
        "team_id, snapshot_month, overall_health_score, health_band, health_narrative",
        over_hot_views),
}

ONE_ACCOUNT = {
    "latest_month_of_account": over_views(
        "select max(snapshot_month) as latest_month from usage where team_id = 1"),
    "load_monthly_usage_of_account": over_views(f"select * from ({_USAGE}) where team_id = 5"),
    "load_risk_flag_of_account": over_views(
        "select team_id, risk_flag, contract_status, days_to_contract_end, "
        "latest_contract_end_date from watchlist where team_id = 5"),
    "load_health_scores_of_account": over_views(
        "select team_id, snapshot_month, health_score from simple_score where team_id = 5"),
    "load_latest_health_summary_of_account": _newest(
        "(select * from scored where team_id = 5) join narrated using (team_id, snapshot_month)",
        "team_id, snapshot_month, overall_health_score, health_band, health_narrative"),
    "user_trend_monthly_corrected": over_views(
        "select team_id, snapshot_month, active_users, users_1 as prev_active_users, "
        "active_users - users_1 as users_delta, "
        + rounded("(active_users - users_1) / nullif(cast(users_1 as double), 0)", 3)
        + " as users_pct_change from stepped"),
    "duplicate_keys": over_views(
        "select team_id % 7 as team_id, snapshot_month, count(*) as rows from raw "
        "group by 1, 2 having count(*) > 1"),
}

STORED = {f"{name}_stored": VIEWS[name] for name in [
    "latest_snapshot", "growth_summary", "monthly_usage", "overall_health_score",
    "at_risk_next_actions", "onboarding_clients"]} | {
    "load_monthly_usage_of_account_stored": ONE_ACCOUNT["load_monthly_usage_of_account"],
    "health_score_monthly_enriched_kept": over_views(
        "select s.team_id, s.company_name, s.snapshot_month, s.overall_health_score, "
        "s.health_band, n.health_narrative from scored s "
        "left join narrated n using (team_id, snapshot_month) where s.team_id is not null"),
    "sql_to_frame_followed": INGEST["sql_to_frame"],
}

ALL = {**VIEWS, **SERVING, **DASHBOARD, **INGEST, **LONG_HISTORY, **HOT, **STORED, **ONE_ACCOUNT}
