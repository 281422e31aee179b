"""The views as chained common table expressions.

Written for checking, not for speed: one expression per rule, separate joins on
(team_id, snapshot_month), and streaks as islands of consecutive row numbers.  The Spark
side computes the same numbers from one frame without these joins.
"""

from __future__ import annotations

AS_OF = "timestamp '2001-10-15 00:00:00'"


def rounded(x: str, digits: int) -> str:
    """Half away from zero, decided on the decimal text of the value; a value less than
    3e-16 of its size below a tie is a tie."""
    nudged = f"({x}) * 1.0::double + ({x}) * 3e-16::double"
    return f"cast(round(cast(cast({nudged} as varchar) as decimal(38,18)), {digits}) as double)"


def lenient_day(text: str) -> str:
    pattern = "^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"
    return (f"case when regexp_matches({text}, '{pattern}') then "
            f"try_cast(substr({text}, 1, 8) || '01' as date) "
            f"+ (try_cast(substr({text}, 9, 2) as integer) - 1) end")


PANEL = """
  panel_m as (
    select l_suppkey as team_id, m, count(*) as n, cast(sum(l_quantity) as bigint) as q,
           cast(sum(l_quantity * l_linenumber) as bigint) as ql
    from (select *, case when l_shipdate >= timestamp '2001-11-01' then timestamp '2001-10-01'
                    else date_trunc('month', l_shipdate) end as m from lineitem)
    group by l_suppkey, m),
  panel_a as (
    select *, (2001*12+10) - (year(m)*12+month(m)) as age from panel_m),
  panel_k as (
    select team_id, m, age,
           case when team_id % 12 = 5 and age < 6 then 5 + 3*age else n end as n,
           case when team_id % 12 = 5 and age < 6 then 60 + 20*age
                when team_id % 12 = 6 and age < 6 then 100 else q end as q,
           case when team_id % 12 = 5 and age < 6 then (60 + 20*age) * (10 + 3*age)
                when team_id % 12 = 6 and age < 6 then 100 * (10 + 3*age) else ql end as ql
    from panel_a),
  panel as (
    select k.team_id, s_name as company_name,
           case when k.team_id % 29 = 28 then 1 end as is_test,
           r_name as region,
           concat(cast(year(m) as varchar(4)), '-',
                  lpad(cast(month(m) as varchar(2)), 2, '0'), '-01') as snapshot_month,
           cast(ql * 2 as bigint) as total_clicks, cast(ql as bigint) as total_clicks_wo_api,
           cast(case when k.team_id % 37 = 36 and n % 2 = 0 then 0
                     when k.team_id % 41 = 40 and n % 2 = 0 then null
                     when k.team_id % 8 = 7 then n else q end as bigint) as active_users,
           cast(n as bigint) as active_coddlers,
           case when k.team_id % 13 = 12 then null when k.team_id % 13 = 11 then 'n/a'
                else concat(cast(1 + (k.team_id % 4) * 8 as varchar(4)), ',',
                            lpad(cast(q % 1000 as varchar(3)), 3, '0'), '.50') end
             as monthly_fee,
           case when k.team_id % 11 = 10 then null
                else concat('Rep ', cast(k.team_id % 7 as varchar(2))) end as salesperson,
           case when k.team_id % 17 = 16 then null when k.team_id % 17 = 15 then '31/12/2001'
                else concat(lpad(cast(1 + (k.team_id * 5) % 12 as varchar(2)), 2, '0'), '/',
                            lpad(cast(1 + k.team_id % 28 as varchar(2)), 2, '0'), '/',
                            cast(2001 + (k.team_id % 5) % 2 as varchar(4))) end
             as latest_contract_end_date,
           cast(sum(n) over (partition by k.team_id order by m) as bigint) as total_jobs
    from panel_k k join supplier on s_suppkey = k.team_id
           join nation on n_nationkey = s_nationkey
           join region on r_regionkey = n_regionkey
    where not (k.team_id % 10 = 3 and age > cast(floor(k.team_id / 10) as int) % 9)
      and not (k.team_id % 19 = 18 and age < 1)
      and not (k.team_id % 23 = 22 and age = 1))"""

# Raw columns the panel leaves empty.
EMPTY_TEXTS = ["source_file", "load_date", "monthly_fee_currency"]
EMPTY_COUNTS = ["non_jobs_clicks", "view_candidates", "number_candidate_emails",
                "number_contact_emails", "active_harvester_accounts", "total_resumes",
                "hires_in_past_year"]
_EMPTY = ", ".join([f"cast(null as varchar) as {c}" for c in EMPTY_TEXTS]
                   + [f"cast(null as bigint) as {c}" for c in EMPTY_COUNTS])

_RAW = f"""
  raw as (
    select company_name, team_id, is_test, region, snapshot_month, total_clicks,
           total_clicks_wo_api, active_coddlers, monthly_fee, salesperson,
           latest_contract_end_date, active_users, total_jobs, {_EMPTY}
    from panel)"""

_FEE_PREFIX = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"

_CLEAN = f"""
  clean as (
    select raw.* exclude (monthly_fee, latest_contract_end_date),
           coalesce(try_cast(nullif(regexp_extract(
                      replace(monthly_fee, ',', ''), '{_FEE_PREFIX}', 1), '') as double),
                    case when monthly_fee is not null then 0.0::double end) as monthly_fee,
           substr(latest_contract_end_date, 7, 4) || '-'
             || substr(latest_contract_end_date, 1, 2) || '-'
             || substr(latest_contract_end_date, 4, 2) as latest_contract_end_date
    from raw where is_test is null or is_test = 0)"""

_SNAPSHOTS = """
  newest as (select max(snapshot_month) as m from clean),
  second_newest as (
    select max(c.snapshot_month) as m from clean c join newest on c.snapshot_month < newest.m),
  latest as (
    select c.*, case when active_users is null or active_users < 1 then 'unknown'
                     when active_users < 10 then 'micro' when active_users < 50 then 'small'
                     when active_users <= 250 then 'medium' else 'large' end as company_size
    from clean c join newest on c.snapshot_month = newest.m),
  previous as (
    select c.* from clean c join second_newest s on c.snapshot_month = s.m)"""

_GROWTH = """
  growth as (
    select l.team_id, l.company_name,
           l.active_users as users_current, p.active_users as users_previous,
           l.active_users - p.active_users as users_change,
           l.total_clicks as clicks_current, p.total_clicks as clicks_previous,
           l.total_clicks - p.total_clicks as clicks_change,
           l.monthly_fee as fee_current, p.monthly_fee as fee_previous,
           l.monthly_fee - p.monthly_fee as fee_change,
           l.total_jobs as jobs_current, p.total_jobs as jobs_previous,
           l.total_jobs - p.total_jobs as jobs_change,
           case when p.active_users is null then 'new'
                when l.active_users > p.active_users then 'growing'
                when l.active_users < p.active_users then 'shrinking' else 'flat' end
             as user_trend
    from latest l left join previous p using (team_id))"""

_CONTRACT = f"""
  contract_days as (
    select team_id, company_name, latest_contract_end_date,
           (epoch(cast({lenient_day('latest_contract_end_date')} as timestamp))
             - epoch({AS_OF})) / 86400.0::double as days
    from latest),
  contract as (
    select team_id, company_name, latest_contract_end_date,
           cast(trunc(days) as integer) as days_to_contract_end,
           case when days < 0 then 'Expired' when days <= 30 then 'Renegotiate (0-30 days)'
                when days <= 90 then 'Renewal window (31-90 days)' else 'Active' end
             as contract_status
    from contract_days)"""

_TENURE = f"""
  started as (select team_id, min(snapshot_month) as first_seen_month from clean group by 1),
  tenure as (
    select l.team_id, l.company_name, s.first_seen_month,
           cast(trunc(date_diff('day', {lenient_day('s.first_seen_month')},
                                {lenient_day('l.snapshot_month')}) / 30.0::double) as integer)
             as months_since_start
    from latest l join started s using (team_id))"""

_WATCHLIST = f"""
  watchlist as (
    select l.team_id, l.company_name, l.region, l.company_size, l.active_users,
           l.total_clicks_wo_api, l.monthly_fee,
           {rounded('l.monthly_fee / nullif(l.active_users, 0)', 2)} as fee_per_user,
           c.latest_contract_end_date, c.days_to_contract_end, c.contract_status,
           g.user_trend, t.months_since_start,
           case when t.months_since_start < 3 then 'Onboarding' else 'Established' end
             as client_stage,
           case when t.months_since_start < 3 then 'Monitor'
                when c.days_to_contract_end <= 30 then 'High'
                when c.days_to_contract_end <= 90
                  then case when g.user_trend = 'Declining' then 'High' else 'Medium' end
                else 'Low' end as risk_flag
    from latest l left join contract c using (team_id)
      left join growth g using (team_id) left join tenure t using (team_id))"""

_NUMBERED = f"""
  usage as (
    select snapshot_month, region, team_id, company_name, total_clicks_wo_api, active_users,
           active_coddlers, monthly_fee,
           coalesce(total_jobs - lag(total_jobs) over w, 0) as jobs_posted
    from clean window w as (partition by team_id order by snapshot_month)),
  numbered as (
    select team_id, company_name, snapshot_month, active_users,
           {rounded('total_clicks_wo_api / cast(nullif(active_users, 0) as double)', 2)} as cpu,
           row_number() over (partition by team_id order by snapshot_month) as seq
    from clean),
  -- each row next to the three rows before it
  stepped as (
    select a.*, b.active_users as users_1, b.cpu as cpu_1, c.cpu as cpu_2, d.cpu as cpu_3,
           b.seq is not null as has_1
    from numbered a
      left join numbered b on b.team_id is not distinct from a.team_id and b.seq = a.seq - 1
      left join numbered c on c.team_id is not distinct from a.team_id and c.seq = a.seq - 2
      left join numbered d on d.team_id is not distinct from a.team_id and d.seq = a.seq - 3),
  user_change as (
    select team_id, company_name, snapshot_month, seq, active_users, users_1,
           (active_users - users_1) * 1.0::double / nullif(users_1, 0) as change
    from stepped),
  engagement_change as (
    select team_id, snapshot_month, seq,
           {rounded('(cpu - cpu_1) / nullif(cpu_1, 0)', 4)} as change
    from stepped),
  jobs_numbered as (
    select team_id, snapshot_month, jobs_posted,
           row_number() over (partition by team_id order by snapshot_month) as seq
    from usage),
  jobs_change as (
    select a.team_id, a.snapshot_month, a.seq,
           (a.jobs_posted - b.jobs_posted) * 1.0::double / nullif(b.jobs_posted, 0) as change
    from jobs_numbered a left join jobs_numbered b
      on b.team_id is not distinct from a.team_id and b.seq = a.seq - 1)"""


def _streaks(signal: str, points: str) -> str:
    """Runs of falling rows: their row number minus their rank among falling rows is equal
    exactly within a run."""
    return f"""
  {signal}_runs as (
    select *, row_number() over (partition by team_id order by seq) as fall_number
    from {signal}_change where change < 0),
  {signal}_streaks as (
    select *, seq - fall_number as breaks_before,
           count(*) over (partition by team_id, seq - fall_number) as streak
    from {signal}_runs),
  {signal}_points as (
    select *, case {points} end as penalty from {signal}_streaks)"""


_STREAKS = ",".join([
    _streaks("engagement", "when streak >= 4 then 40 when streak = 3 then 20 "
                           "when streak = 2 then 10 else 0"),
    _streaks("user", "when streak >= 4 then 20 when streak = 3 then 10 "
                     "when streak = 2 then 5 else 0"),
    _streaks("jobs", "when streak >= 5 then 45 when streak = 4 then 30 "
                     "when streak = 3 then 15 when streak = 2 then 5 else 0"),
])

_SHARP = """
  sharp as (
    select a.team_id, a.company_name, a.snapshot_month, a.active_users, a.users_1, a.change,
           -- least skips missing values here
           least(a.change, b.change, c.change) as worst
    from user_change a
      left join user_change b on b.team_id is not distinct from a.team_id and b.seq = a.seq - 1
      left join user_change c on c.team_id is not distinct from a.team_id and c.seq = a.seq - 2),
  sharp_points as (
    select *, case when worst <= -0.20::double then 1 else 0 end as is_sharp from sharp)"""

_PRICING = f"""
  pricing as (
    select c.team_id, c.company_name, c.snapshot_month, l.monthly_fee, l.active_users,
           l.company_size,
           {rounded('l.monthly_fee / nullif(l.active_users, 0)', 2)} as fee_per_user,
           case when l.monthly_fee <> 0 then 1 else 0 end as has_pricing_data
    from clean c left join latest l using (team_id))"""

_SCORED = """
  factors as (
    select c.team_id, c.company_name, c.snapshot_month,
           e.penalty as engagement_penalty, e.streak as engagement_streak,
           u.penalty as user_penalty, s.is_sharp * 10 as sharp_decline_penalty,
           j.penalty as jobs_penalty, p.fee_per_user, p.has_pricing_data
    from clean c
      left join engagement_points e using (team_id, snapshot_month)
      left join user_points u using (team_id, snapshot_month)
      left join sharp_points s using (team_id, snapshot_month)
      left join jobs_points j using (team_id, snapshot_month)
      left join pricing p using (team_id, snapshot_month)),
  points_left as (
    select *, 100 - coalesce(engagement_penalty, 0) - coalesce(user_penalty, 0)
                  - coalesce(sharp_decline_penalty, 0) - coalesce(jobs_penalty, 0) as points
    from factors),
  scored as (
    select *, case when points < 0 then 0 else points end as overall_health_score,
           case when points < 40 then 'Critical' when points < 60 then 'At Risk'
                when points < 80 then 'Watch' else 'Healthy' end as health_band
    from points_left),
  narrated as (
    select team_id, company_name, snapshot_month,
           trim(case when engagement_streak in (2, 3)
                       then 'Engagement is trending down compared to previous months. '
                     when engagement_streak > 3
                       then 'Engagement has declined for several consecutive months. '
                     else '' end
             || case when user_penalty > 0
                       then 'Active user numbers have reduced over recent periods. '
                     else '' end
             || case when sharp_decline_penalty > 0
                       then 'A significant drop in active users was recorded recently. '
                     else '' end
             || case when jobs_penalty > 0
                       then 'Job posting activity has decreased compared to earlier months. '
                     else '' end
             || case when has_pricing_data = 1 and fee_per_user < 30
                       then 'Account appears cost-efficient given current usage. '
                     when has_pricing_data = 1 and fee_per_user > 100
                       then 'Cost per user is relatively high for the current licence base. '
                     else '' end) as health_narrative
    from factors)"""

_ENGAGEMENT_TREND = """
  averaged as (
    select team_id, company_name, snapshot_month, seq, cpu,
           (coalesce(cpu_2, 0) + coalesce(cpu_1, 0) + coalesce(cpu, 0))
             / nullif((cpu_2 is not null)::int + (cpu_1 is not null)::int
                      + (cpu is not null)::int, 0) as average
    from stepped),
  engagement as (
    select a.team_id, a.company_name, a.snapshot_month, a.cpu as clicks_per_user,
           a.average as clicks_per_user_3m_avg, a.average - b.average as engagement_delta
    from averaged a left join averaged b on b.team_id is not distinct from a.team_id and b.seq = a.seq - 1)"""

_USER_TREND = f"""
  user_trend as (
    select team_id, snapshot_month, active_users, active_users - users_1 as prev_active_users,
           users_1 + 0 * active_users as users_delta,
           {rounded('users_1 * 1.0::double / nullif(active_users - users_1, 0)', 3)}
             as users_pct_change
    from stepped)"""

_SIMPLE = f"""
  simple_penalties as (
    select l.team_id, l.company_name, l.snapshot_month,
           case when e.engagement_delta is null then null
                when e.engagement_delta >= -0.05::double then 0.0::double
                when abs(e.engagement_delta) * 100 * 1.2::double > 50 then 50.0::double
                else abs(e.engagement_delta) * 100 * 1.2::double end as engagement_penalty,
           case when u.users_pct_change <= -0.20::double then 25
                when u.users_pct_change <= -0.10::double then 15
                when u.users_pct_change <= -0.05::double then 5 else 0 end as user_penalty
    from latest l left join engagement e using (team_id, snapshot_month)
      left join user_trend u using (team_id, snapshot_month)),
  simple_score as (
    select team_id, company_name, snapshot_month,
           case when engagement_penalty is null then null
                when 100 - engagement_penalty - user_penalty < 0 then 0.0::double
                else {rounded('100 - engagement_penalty - user_penalty', 0)} end
             as health_score
    from simple_penalties)"""

_OVERVIEW = """
  overview as (
    select l.team_id, l.company_name, l.company_size, l.region, l.monthly_fee, l.salesperson,
           t.months_since_start,
           case when t.months_since_start < 6 then 'Onboarding' else 'Established' end
             as client_stage,
           s.overall_health_score
    from latest l left join tenure t using (team_id)
      left join scored s using (team_id, snapshot_month))"""

_ACTIONS = """
  actions as (
    select l.company_name, l.team_id, l.region, l.salesperson, s.overall_health_score,
           s.health_band, n.health_narrative, w.risk_flag, w.contract_status,
           w.days_to_contract_end, w.user_trend, e.engagement_delta, l.company_size,
           l.monthly_fee,
           case when s.overall_health_score < 40 then 'Urgent outreach – disengaging'
                when w.contract_status = 'Expired' then 'Commercial check-in'
                when starts_with(w.contract_status, 'Renegotiate') then 'Renewal conversation'
                when w.user_trend = 'Declining' then 'Adoption review'
                when l.company_size in ('large', 'medium')
                  and s.overall_health_score >= 50 and s.overall_health_score <= 65
                  then 'Proactive value review'
                else 'Monitor' end as recommended_action
    from latest l
      join scored s using (team_id, snapshot_month)
      join tenure t on t.team_id = l.team_id and t.months_since_start >= 3
      left join watchlist w on w.team_id = l.team_id
      left join engagement e on e.team_id = l.team_id and e.snapshot_month = l.snapshot_month
      left join narrated n on n.team_id = l.team_id and n.snapshot_month = l.snapshot_month)"""

_ONBOARDING = """
  onboarding as (
    select c.team_id, c.company_name, o.salesperson, o.client_stage, o.months_since_start,
           case when o.months_since_start < 1 then 'Month 0–1'
                when o.months_since_start < 3 then 'Month 1–3'
                when o.months_since_start < 6 then 'Month 3–6' else '6+ Months' end
             as onboarding_age_band,
           c.region, c.snapshot_month, c.total_clicks_wo_api, c.active_coddlers,
           c.monthly_fee, case when c.monthly_fee > 80 then 1 else 0 end as has_paid_users,
           c.active_users, c.total_resumes, c.total_jobs, c.hires_in_past_year
    from overview o left join clean c using (team_id) where o.client_stage = 'Onboarding')"""

CHAIN = ",".join([
    PANEL, _RAW, _CLEAN, _SNAPSHOTS, _GROWTH, _CONTRACT, _TENURE, _WATCHLIST, _NUMBERED,
    _STREAKS, _SHARP, _PRICING, _SCORED, _ENGAGEMENT_TREND, _USER_TREND, _SIMPLE, _OVERVIEW,
    _ACTIONS, _ONBOARDING])


def over_views(select: str) -> str:
    """A statement over the chain above."""
    return f"with {CHAIN}\n{select}"


# The panel again as the months of account -1, and a third of its accounts without an id.
_HOT = """
  placed as (
    select panel.*, team_id * 100 + (cast(substr(snapshot_month, 1, 4) as int) - 1995) * 12
                    + cast(substr(snapshot_month, 6, 2) as int) as place from panel),
  moved as (
    select * exclude (place) replace (
             null as is_test,
             lpad(cast(1000 + place // 12 as varchar), 4, '0') || '-'
               || lpad(cast(1 + place % 12 as varchar), 2, '0') || '-01' as snapshot_month)
    from placed),
  panel_hot as (
    select * from panel
    union all by name select * replace (-1 as team_id) from moved
    union all by name select * replace (null as team_id) from moved where team_id % 3 = 0)"""


def over_hot_views(select: str) -> str:
    """The same over the panel with one long history and many rows without an id."""
    chain = CHAIN.replace(_RAW, f"{_HOT},{_RAW.replace('from panel', 'from panel_hot')}")
    return f"with {chain}\n{select}"
