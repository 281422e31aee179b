"""The raw table: what its ledger makes visible, what plans take from it, loads at once."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from conftest import monthly
from tidemark.operators.facts import facts_of
from tidemark.operators.history import Bounds, settled_layout
from tidemark.plans import health, registry, serving, snapshots
from tidemark.plans.accounts import at_risk_next_actions
from tidemark.plans.catalog import view
from tidemark.schema import RAW_PARTITIONS
from tidemark.sources import raw_table
from tidemark.sources.panel import AS_OF, panel
from tidemark.sources.raw_table import append_rows, enter, load_rows, open_ledger, read_ledger, read_raw_table, write_rows

SF_DIR = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def rows_of(raw, team, months=3, region="UK", **series):
    series = series or {"active_users": [10 * team + i for i in range(months)]}
    return raw([r | {"region": region} for r in monthly(team, **series)])


def listed(spark, path):
    return sorted((r["snapshot_month"], r["region"], r["team_id"], r["active_users"]) for r in read_raw_table(spark, path).collect())


def test_rows_count_once_the_ledger_names_them(spark, raw, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert read_raw_table(spark, path).count() == 0
    assert len(load_rows(rows_of(raw, 1), path)) == 3
    before, held = listed(spark, path), read_raw_table(spark, path)

    def killed(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(raw_table, "enter", killed)
        for replace in (False, True):
            with pytest.raises(KeyboardInterrupt):
                load_rows(rows_of(raw, 2, 5), path, replace=replace)
    assert listed(spark, path) == before and len(before) == 3

    # the same rows again: what is there stays, what is new comes in
    assert load_rows(rows_of(raw, 2, 5), path) == [("2025-04-01", "UK"), ("2025-05-01", "UK")]
    assert [(m, t) for m, _, t, _ in listed(spark, path)] == [
        ("2025-01-01", 1), ("2025-02-01", 1), ("2025-03-01", 1), ("2025-04-01", 2), ("2025-05-01", 2)]
    # one entry switches all three months
    assert len(load_rows(rows_of(raw, 3), path, replace=True)) == 3
    assert [t for _, _, t, _ in listed(spark, path)] == [3, 3, 3, 2, 2]
    # a frame read before keeps to its rows
    assert sorted({r["team_id"] for r in held.collect()}) == [1]


def test_half_an_entry_counts_as_none(spark, raw, tmp_path):
    path = str(tmp_path / "t")
    load_rows(rows_of(raw, 1), path)
    whole = sorted((tmp_path / "t" / "_ledger").glob("*.json"))[-1].read_text()
    number = len(list((tmp_path / "t" / "_ledger").glob("*.json")))
    half = whole.replace('"rows": 1', '"rows": 7').splitlines()[0]
    (tmp_path / "t" / "_ledger" / f"{number:012d}.json").write_text(half + "\n" + half[:40])
    assert [r["rows"] for r in read_ledger(spark, path).collect()] == [1, 1, 1]
    assert load_rows(rows_of(raw, 2, 4), path) == [("2025-04-01", "UK")]
    assert len(listed(spark, path)) == 4


def test_names_that_need_escapes(spark, raw, tmp_path):
    path, names = str(tmp_path / "t's"), ["A'B", "new york+50%", "x=y/z", 'q"\\', "ü {1} $"]
    for i, name in enumerate(names):
        load_rows(rows_of(raw, i, 2, region=name), path)
    assert sorted({r[1] for r in listed(spark, path)}) == sorted(names) and len(listed(spark, path)) == 10


def test_loads_at_once_add_each_month_once(spark, raw, tmp_path, monkeypatch):
    """All loads see the same ledger before any of them enters its rows."""
    path, ready, real = str(tmp_path / "t"), threading.Barrier(3), raw_table.read_ledger
    open_ledger(spark, path)
    seen = threading.local()

    def together(*args):
        found = real(*args)
        if getattr(seen, "in_enter", False) and not getattr(seen, "met", False):
            seen.met = True
            found = spark.createDataFrame(found.collect(), found.schema)
            ready.wait(120)
        return found

    monkeypatch.setattr(raw_table, "read_ledger", together)
    entered = {}

    def load(team):
        folder = write_rows(rows_of(raw, team, 2 + team), path)
        seen.in_enter = True
        entered[team] = enter(spark, path, [
            {"snapshot_month": f"2025-{m + 1:02d}-01", "region": "UK", "rows": 1, "kept_rows": 1, "most_rows": 1, "folder": folder, "buckets": 0}
            for m in range(2 + team)])

    threads = [threading.Thread(target=load, args=(team,)) for team in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.undo()
    assert sorted(m for keys in entered.values() for m, _ in keys) == ["2025-01-01", "2025-02-01", "2025-03-01", "2025-04-01"]
    assert [m for m, _, _, _ in listed(spark, path)] == ["2025-01-01", "2025-02-01", "2025-03-01", "2025-04-01"]


def test_months_and_bounds_of_the_ledger(spark, raw, tmp_path):
    path = str(tmp_path / "t")
    load_rows(rows_of(raw, 1, 4), path)
    load_rows(raw([r | {"region": "US", "is_test": 1} for r in monthly(5, start="2025-05", active_users=[1, 2])]), path)
    load_rows(raw([{"region": "FR", "snapshot_month": "2025-01-01", "team_id": t} for t in (7, 7, 7, None, None, None, None)]), path)
    table = read_raw_table(spark, path)
    facts = facts_of(snapshots.clients_clean(table))
    # test accounts do not make a month; 1 for each of six months, and four without an id
    assert (facts.latest, facts.previous, facts.longest) == ("2025-04-01", "2025-03-01", 10)
    plain = table.where(F.lit(True))
    assert facts_of(plain) is None
    for name in ("latest_snapshot", "previous_snapshot", "growth_summary", "monthly_usage", "overall_health_score", "onboarding_clients"):
        got, want = (view(name, frame, AS_OF) for frame in (table, plain))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    clean = snapshots.clients_clean(table)
    assert settled_layout(clean, "auto") == "window" and settled_layout(clean, Bounds(history_rows=9)) == Bounds(history_rows=9, long_accounts=())
    assert settled_layout(snapshots.clients_clean(plain), "auto") == "auto"
    with pytest.raises(ValueError, match="unknown layout"):
        view("monthly_usage", table, layout="nothing")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The panel in a table of eight buckets, loaded in two parts, and in a table without."""
    rows = panel(spark, SF_DIR).persist()
    folder = tmp_path_factory.mktemp("stored")
    for part in (rows.where("snapshot_month < '1999'"), rows.where("snapshot_month >= '1999'")):
        load_rows(part, str(folder / "buckets"), buckets=8)
        load_rows(part, str(folder / "plain"))
    yield {name: read_raw_table(spark, str(folder / name)) for name in ("buckets", "plain")}
    rows.unpersist()


def test_history_in_buckets_needs_no_exchange(stored):
    clean = snapshots.clients_clean(stored["buckets"])
    for frame in (health.overall_health_score(clean, layout="auto"), view("monthly_usage", stored["buckets"]),
                  view("user_monthly_penalty", stored["buckets"])):
        text = plan(frame)
        assert "Exchange" not in text and "Join" not in text and "SelectedBucketsCount: 8 out of 8" in text
    assert "Exchange hashpartitioning(team_id" in plan(health.overall_health_score(snapshots.clients_clean(stored["plain"])))
    # the join of the latest rows with their signals is by account too
    assert not re.search(r"Exchange hashpartitioning\(team_id", plan(at_risk_next_actions(clean, AS_OF, ordered=False)))


def test_one_account_reads_one_bucket(stored):
    clean = snapshots.clients_clean(stored["buckets"])
    for frame in (serving.load_monthly_usage(clean, 5), serving.load_latest_health_summary(clean, 5)):
        text = plan(frame)
        assert "SelectedBucketsCount: 1 out of 8" in text and "Exchange" not in text


def test_latest_month_is_read_alone(spark, stored):
    """Months are literals, so the files of others are not even listed for the scan."""
    for name in ("buckets", "plain"):
        clean = snapshots.clients_clean(stored[name])
        for frame, month in ((snapshots.latest_snapshot(clean), "2001-10-01"), (snapshots.previous_snapshot(clean), "2001-09-01")):
            assert "Subquery" not in plan(frame)
            files = frame.select(F.col("snapshot_month")).inputFiles()
            assert files and all(f"snapshot_month={month}" in f for f in files)


@pytest.mark.parametrize("name", ["overall_health_score", "at_risk_next_actions", "monthly_usage", "company_overview", "onboarding_clients", "growth_summary"])
def test_stored_tables_give_the_same_rows(spark, stored, name):
    want = sorted(map(str, view(name, panel(spark, SF_DIR), AS_OF, layout="window").collect()))
    for table in stored.values():
        assert sorted(map(str, view(name, table, AS_OF).collect())) == want


def test_an_older_table_and_mixed_buckets(spark, raw, tmp_path):
    path = str(tmp_path / "t")
    append_rows(rows_of(raw, 1, 2), path)
    assert len(listed(spark, path)) == 2 and facts_of(read_raw_table(spark, path)) is None
    assert load_rows(rows_of(raw, 2, 3), path, buckets=4) == [("2025-03-01", "UK")]
    assert load_rows(rows_of(raw, 3, 4), path) == [("2025-04-01", "UK")]  # as the load before
    assert {r["buckets"] for r in read_ledger(spark, path).collect()} == {0, 4}
    assert [t for _, _, t, _ in listed(spark, path)] == [1, 1, 2, 3]
    text = plan(view("monthly_usage", read_raw_table(spark, path)))
    assert "Exchange hashpartitioning(team_id" in text  # read without buckets
    assert read_ledger(spark, path).select(*RAW_PARTITIONS).distinct().count() == 4


def test_long_accounts_are_known_from_the_ledger(spark, raw, tmp_path, monkeypatch):
    """Busy accounts are cut without a count of all; where the bounds do not tell, they are counted."""
    monkeypatch.setattr(raw_table, "BUSY_ROWS", 3)
    path, other = str(tmp_path / "t"), str(tmp_path / "other")
    rows = [r | {"active_users": i} for month in range(1, 6) for i, r in enumerate(
        [{"team_id": 1}] * 9 + [{"team_id": 2}] * (5 if month == 2 else 2) + [{"team_id": 3}] + [{"team_id": None}] * 7)
        for r in [r | {"region": "UK", "company_name": f"c{r['team_id']}", "snapshot_month": f"2025-0{month}-01"}]]
    for month in range(1, 6):
        load_rows(raw([r for r in rows if r["snapshot_month"] == f"2025-0{month}-01"]), path)
    table = read_raw_table(spark, path)
    facts = facts_of(table)
    # account 2 is named once; in other months it may have as many rows as any that is not named
    assert (facts.longest, facts.others, facts.busy) == (45, 9, {1: 45, 2: 13})
    assert facts.longer_than(12) == (1, 2) and facts.longer_than(13) == (1,) and facts.longer_than(45) == () and facts.longer_than(8) is None
    clean, bounds = snapshots.clients_clean(table), Bounds(history_rows=12, block_rows=4)
    assert settled_layout(clean, bounds).long_accounts == (1, 2)
    assert settled_layout(clean, Bounds(history_rows=8)) == Bounds(history_rows=8)
    from tidemark.operators.history import account_timeline
    want = sorted(map(str, account_timeline(clean, "window").collect()))
    names = account_timeline(clean, "window").columns
    for layout in (bounds, Bounds(history_rows=8, block_rows=4), Bounds(history_rows=44, block_rows=10)):
        assert sorted(map(str, account_timeline(clean, layout).select(*names).collect())) == want
    counts = "HashAggregate(keys=[team_id"
    assert plan(account_timeline(clean, bounds)).count(counts) < plan(account_timeline(clean, Bounds(history_rows=8, block_rows=4))).count(counts)
    monkeypatch.setattr(raw_table, "BUSY_ACCOUNTS", 1)
    load_rows(raw([r for r in rows if r["snapshot_month"] == "2025-02-01"]), other)
    assert (facts_of(read_raw_table(spark, other)).others, facts_of(read_raw_table(spark, other)).busy) == (9, {})


def test_buckets_grow_with_the_rows_to_hold():
    assert [raw_table.buckets_for(n) for n in (0, 82_000, 2_800_001, 30_000_000)] == [4, 4, 5, 43]


def test_stored_queries_bucket_by_the_size_of_the_tables(spark, tmp_path, monkeypatch):
    for table, rows in {
            "supplier": "select id s_suppkey, concat('S', id) s_name, 0 s_nationkey from range(1, 7)",
            "lineitem": "select s.id l_suppkey, m.id + 1 l_linenumber, 5d l_quantity, add_months(timestamp '1998-11-03', 7 * int(m.id)) l_shipdate "
                        "from range(1, 7) s cross join range(6) m",
            "nation": "select 0 n_nationkey, 0 n_regionkey", "region": "select 0 r_regionkey, 'ASIA' r_name"}.items():
        spark.sql(rows).write.parquet(str(tmp_path / f"{table}.parquet"))
    monkeypatch.setattr(raw_table, "BUCKET_ROWS", 100)
    clean = registry.QUERIES["latest_snapshot_stored"](spark, str(tmp_path))
    path = f"{registry._stored(spark, str(tmp_path))}/clients_raw"
    # six accounts of 82 months at most
    assert {r["buckets"] for r in read_ledger(spark, path).collect()} == {5}
    assert sorted(map(str, read_raw_table(spark, path).collect())) == sorted(map(str, panel(spark, str(tmp_path)).collect()))
    assert clean.count() == 6
