"""The timeline kept month by month, against the whole one."""

import pytest
from pyspark.sql import functions as F

from conftest import monthly
from tidemark.operators.history import account_timeline
from tidemark.plans.health import scored_history, scored_timeline
from tidemark.plans.snapshots import clients_clean, snapshot_months
from tidemark.schema import VIEW_COLUMNS
from tidemark.sources import timeline_table
from tidemark.sources.panel import panel
from tidemark.sources.raw_table import load_rows, read_raw_table
from tidemark.sources.timeline_table import newest_version, read_timeline, update_timeline

SF_DIR = "/root/testdata/sf0.001"


def bag(frame):
    names = sorted(frame.columns)
    return sorted(map(str, frame.select(*names).collect()))


def assert_same(spark, raw_path, path):
    clean = clients_clean(read_raw_table(spark, raw_path))
    want = account_timeline(clean.where("team_id is not null"))
    got = read_timeline(spark, path)
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got) == bag(want)
    return clean


def test_month_by_month_replay_of_the_panel(spark, tmp_path):
    """A first load of most months, then one month at a time: each state of the table equals the full run."""
    rows = panel(spark, SF_DIR).persist()
    months = sorted(r[0] for r in rows.select("snapshot_month").distinct().collect())
    raw_path, path = str(tmp_path / "raw"), str(tmp_path / "timeline")
    load_rows(rows.where(F.col("snapshot_month") < months[-4]), raw_path)
    update_timeline(spark, raw_path, path)
    assert_same(spark, raw_path, path)
    for i, month in enumerate(months[-4:]):
        load_rows(rows.where(F.col("snapshot_month") == month), raw_path)
        version = update_timeline(spark, raw_path, path)
        assert version.number == i + 1 and update_timeline(spark, raw_path, path) == version
        if i in (0, 3):
            clean = assert_same(spark, raw_path, path)
    columns = VIEW_COLUMNS["overall_health_score"]
    scores = scored_timeline(read_timeline(spark, path), snapshot_months(clean)["latest"]).select(*columns)
    assert bag(scores) == bag(scored_history(clean).where("team_id is not null").select(*columns))
    rows.unpersist()


def streaks(start, values, team=1, **more):
    return monthly(team, start, active_users=values, total_clicks_wo_api=[100 * v for v in values], total_jobs=[0] * len(values), **more)


def test_streaks_across_updates(spark, raw, tmp_path):
    """Streaks that go on, end, begin, and accounts that come, pause and go; copies and missing ids."""
    raw_path, path = str(tmp_path / "raw"), str(tmp_path / "timeline")
    series = {1: [50, 40, 30, 20, 10, 60, 50, 40], 2: [5, 6, 7, 6, 5, 4, 3, 2], 3: [None, 9, None, 8, 7, None, 7, 6]}
    rows = [r for team, values in series.items() for r in monthly(
        team, active_users=values, total_clicks_wo_api=[(v or 3) * (i + 2) for i, v in enumerate(values)],
        total_jobs=[i * i % 7 for i in range(8)], monthly_fee=[None if i % 3 == 2 else "10" for i in range(8)])]
    rows += monthly(4, "2025-04", active_users=[9, 8, 7]) + monthly(5, "2025-01", active_users=[4, 3]) + monthly(5, "2025-06", active_users=[2, 1, 1])
    rows += monthly(None, active_users=list(range(8))) + [r | {"region": "again"} for r in monthly(2, "2025-03", active_users=[1, 2, 3])]
    for at, month in enumerate(f"2025-0{m}-01" for m in range(1, 9)):
        if at not in (3, 6):  # two updates take in two months at once
            load_rows(raw([{"region": "UK"} | r for r in rows if r["snapshot_month"] <= month]), raw_path)
            update_timeline(spark, raw_path, path)
            assert_same(spark, raw_path, path)


def test_late_and_replaced_months_begin_anew(spark, raw, tmp_path):
    raw_path, path = str(tmp_path / "raw"), str(tmp_path / "timeline")
    with pytest.raises(ValueError, match="no month"):
        update_timeline(spark, raw_path, path)
    with pytest.raises(ValueError, match="no timeline"):
        read_timeline(spark, path)

    def load(rows, region="UK", **options):
        load_rows(raw([r | {"region": region} for r in rows]), raw_path, **options)
        version = update_timeline(spark, raw_path, path)
        assert_same(spark, raw_path, path)
        return version

    assert len(load(streaks("2025-03", [9, 8, 7])).settled) == 1
    assert len(load(streaks("2025-06", [6, 9])).settled) == 2
    assert len(load(streaks("2025-01", [3, 2])).settled) == 1  # earlier months
    assert len(load(streaks("2025-08", [8])).settled) <= 2
    assert len(load(streaks("2025-04", [50]), replace=True).settled) == 1
    assert len(load(streaks("2025-04", [3], team=2), region="US").settled) == 1  # the month has more rows


def test_an_update_that_breaks_off(spark, raw, tmp_path, monkeypatch):
    raw_path, path = str(tmp_path / "raw"), str(tmp_path / "timeline")
    load_rows(raw([r | {"region": "UK"} for r in streaks("2025-01", [9, 8, 7])]), raw_path)
    first = update_timeline(spark, raw_path, path)
    load_rows(raw([r | {"region": "UK"} for r in streaks("2025-04", [6, 9])]), raw_path)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(timeline_table.numbered, "create", killed)
        with pytest.raises(KeyboardInterrupt):
            update_timeline(spark, raw_path, path)
    assert newest_version(spark, path) == first
    (tmp_path / "timeline" / "_versions" / "000000000001.json").write_text('{"settled": ["_da')
    assert newest_version(spark, path) == first
    assert update_timeline(spark, raw_path, path).number == 2
    assert_same(spark, raw_path, path)


def test_an_update_reads_no_settled_row(spark, raw, tmp_path):
    raw_path, path = str(tmp_path / "raw"), str(tmp_path / "timeline")
    load_rows(raw([r | {"region": "UK"} for r in streaks("2025-01", [5, 6, 7, 6, 5])]), raw_path)
    version = update_timeline(spark, raw_path, path)
    assert version.settled and version.open
    load_rows(raw([r | {"region": "UK"} for r in streaks("2025-06", [4])]), raw_path)
    for folder in version.settled:
        for file in (tmp_path / "timeline" / folder).iterdir():
            file.rename(tmp_path / f"away-{file.name.strip('.')}")
    assert update_timeline(spark, raw_path, path).number == 1
