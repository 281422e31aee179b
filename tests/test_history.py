"""The account timeline against a plain restatement of the rules, in both layouts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.blocks import blocked_timeline, long_accounts, with_blocks
from tidemark.operators.checks import duplicate_keys, longest_history
from tidemark.operators.history import ROW_ORDER, Bounds, account_timeline, tie_break
from tidemark.plans.catalog import view

COLUMNS = ["team_id", "snapshot_month", "jobs_posted", "user_pct_change", "worst_3m_pct_change",
           "user_breaks", "user_streak", "jobs_streak", "user_streak_so_far",
           "first_seen_month", "last_month", "last_active_users", "rows_from_here", "position"]


def random_accounts(seed: int) -> list[dict]:
    """Accounts with gaps, empty values, zeros, long and very short histories."""
    rng = random.Random(seed)
    months = [f"{y}-{m:02d}-01" for y in range(2015, 2026) for m in range(1, 13)]
    rows = []
    for team in range(25):
        share = rng.choice([0.02, 0.1, 0.5, 1.0])
        users, jobs = rng.randint(1, 200), 0
        for month in months:
            if rng.random() > share:
                continue
            users = max(0, users + rng.choice([-20, -5, -1, -1, 0, 3]))
            jobs += rng.randint(0, 3)
            rows.append({"team_id": team, "snapshot_month": month, "company_name": "c",
                         "active_users": None if rng.random() < 0.05 else users,
                         "total_jobs": jobs, "total_clicks_wo_api": rng.randint(0, 500)})
    return rows


def change(now, before):
    return (now - before) / before if now is not None and before else None


def whole_streaks(changes: list) -> list:
    lengths, start = [None] * len(changes), 0
    for i in range(len(changes) + 1):
        if i == len(changes) or not (changes[i] is not None and changes[i] < 0):
            lengths[start:i] = [i - start] * (i - start)
            start = i + 1
    return lengths


def expected_rows(rows: list[dict]) -> list[tuple]:
    result = []
    for team in sorted({r["team_id"] for r in rows}):
        own = sorted((r for r in rows if r["team_id"] == team), key=lambda r: r["snapshot_month"])
        users = [r["active_users"] for r in own]
        posted = [0] + [b["total_jobs"] - a["total_jobs"] for a, b in zip(own, own[1:])]
        user_changes = [None] + [change(b, a) for a, b in zip(users, users[1:])]
        job_changes = [None] + [change(b, a) for a, b in zip(posted, posted[1:])]
        falling = [c is not None and c < 0 for c in user_changes]
        for i, row in enumerate(own):
            last_three = [c for c in user_changes[max(0, i - 2):i + 1] if c is not None]
            breaks = falling[:i + 1].count(False)
            since = next((k for k in range(i, -1, -1) if not falling[k]), -1)
            result.append((
                team, row["snapshot_month"], posted[i], user_changes[i],
                min(last_three, default=None), breaks, whole_streaks(user_changes)[i],
                whole_streaks(job_changes)[i], i - since if falling[i] else None,
                own[0]["snapshot_month"], own[-1]["snapshot_month"], users[-1],
                len(own) - i, i + 1))
    return result


@pytest.mark.parametrize("seed", [1, 2])
def test_timeline_in_both_layouts(spark, raw, seed):
    rows = random_accounts(seed)
    random.Random(seed).shuffle(rows)
    table = raw(rows)
    expected = Counter(expected_rows(rows))
    for frame in (account_timeline(table), account_timeline(table, "blocks"),
                  blocked_timeline(table, block=F.substring("snapshot_month", 1, 7))):
        assert Counter(tuple(r) for r in frame.select(*COLUMNS).collect()) == expected


def test_windows_run_in_many_tasks(spark, raw):
    """Few shuffled bytes are no reason to sort all rows in a few tasks, also if rows come by account."""
    table = raw([{"team_id": t, "snapshot_month": f"2025-0{m}-01", "active_users": t} for t in range(200) for m in (1, 2)])
    own, tasks = spark.conf.get("spark.sql.shuffle.partitions"), 40
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        by_account = table.withColumn("total_jobs", F.sum("active_users").over(Window.partitionBy("team_id").orderBy("snapshot_month")))
        found = account_timeline(by_account, Bounds())
        assert found.select(F.spark_partition_id()).distinct().count() > tasks
        text = account_timeline(table, "blocks")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"Exchange hashpartitioning\(team_id#\d+L?, block#\d+L?, \d+\), REPARTITION_BY_NUM", text)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", own)


def test_layouts_have_the_same_columns(spark, raw):
    table = raw(random_accounts(3))
    window, blocks = account_timeline(table), account_timeline(table, "blocks")
    assert set(window.columns) == set(blocks.columns)
    shared = sorted(window.columns)
    assert (Counter(map(tuple, window.select(*shared).collect()))
            == Counter(map(tuple, blocks.select(*shared).collect())))


def test_long_accounts(spark, raw):
    table = raw(random_accounts(1))
    longest = longest_history(table).first()["rows"]
    assert long_accounts(table, Bounds(longest)).count() == 0
    assert long_accounts(table, Bounds(longest - 1)).count() > 0
    assert long_accounts(table, Bounds(longest - 1, accounts=1)).count() == 0  # a fair share
    with pytest.raises(ValueError):
        account_timeline(table, "other")


@pytest.mark.parametrize("bounds", [Bounds(50, 7), Bounds(10, 1), "auto"])
def test_auto_layout_with_copies_and_rows_without_id(spark, raw, bounds):
    """Rows of one month keep one order, whichever way an account goes."""
    rng = random.Random(5)
    rows = random_accounts(4)
    rows += [{**r, "total_jobs": rng.randint(0, 9)} for r in rng.sample(rows, 60)] + rows[:20]
    rows += [{**r, "team_id": None} for r in rows[:150]]
    table = raw(rows)
    expected = Counter(map(tuple, account_timeline(table).select(*COLUMNS).collect()))
    for frame in (account_timeline(table, bounds), blocked_timeline(table, 5)):
        assert Counter(map(tuple, frame.select(*COLUMNS).collect())) == expected


def test_blocks_are_bounded_by_rows(spark, raw):
    rng = random.Random(6)
    rows = [{"team_id": rng.choice([None, 1]), "snapshot_month": rng.choice(["2025-01-01"] * 5 + ["2025-02-01", None]),
             "active_users": i} for i in range(4000)]
    sizes = [r["count"] for r in with_blocks(raw(rows).withColumn(ROW_ORDER, tie_break()), 100).groupBy("team_id", "block").count().collect()]
    # a month that begins in a block may fill it once more; parts of a month are even by a hash
    assert sum(sizes) == 4000 and max(sizes) <= 200


def test_copies_are_not_multiplied(spark, raw):
    rows = [{"team_id": t, "company_name": f"c{t}", "snapshot_month": f"2025-0{m}-01", "region": "UK",
             "active_users": 20 + m, "total_jobs": 5 * m, "total_clicks_wo_api": 100 * m, "monthly_fee": "10"}
            for t in (1, 2) for m in range(1, 6)]
    rows += [rows[4]] * 2 + [{**rows[4], "active_users": 3}] + [rows[0]]
    table = raw(rows)
    latest = sum(r["snapshot_month"] == "2025-05-01" for r in rows)
    for name, count in (("company_overview", latest), ("at_risk_next_actions", latest),
                        ("onboarding_clients", len(rows)), ("overall_health_score", len(rows))):
        assert view(name, table).count() == count, name


def test_building_a_view_runs_no_job(spark, raw):
    table = raw(random_accounts(1)[:5])
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    for name in ("clients_clean", "overall_health_score", "at_risk_next_actions"):
        view(name, table)
    assert len(tracker.getJobIdsForGroup(None)) == before


def test_duplicate_keys(spark, raw):
    rows = random_accounts(1)
    assert duplicate_keys(raw(rows)).count() == 0
    twice = duplicate_keys(raw([*rows, rows[0], rows[0]])).collect()
    assert [tuple(r) for r in twice] == [(rows[0]["team_id"], rows[0]["snapshot_month"], 3)]
