"""What the plans must keep at any size: few shuffles, pruned scans, no Python, no products."""

import re

import pytest

from tidemark.plans import health, serving, snapshots
from tidemark.plans.accounts import at_risk_next_actions
from tidemark.plans.registry import QUERIES
from tidemark.sources.panel import panel
from tidemark.sources.raw_table import append_rows, read_raw_table


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "raw")
    append_rows(panel(spark, "/root/testdata/sf0.001"), path)
    return snapshots.clients_clean(read_raw_table(spark, path))


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_score_shuffles_the_history_once(clean):
    text = plan(health.overall_health_score(clean))
    assert len(re.findall(r"Exchange hashpartitioning\(team_id", text)) == 1
    assert "Join" not in text
    assert len(re.findall(r"[ -] Sort \[team_id", text)) == 2


def test_actions_carry_only_numbers_through_the_windows(clean):
    text = plan(at_risk_next_actions(clean, ordered=False))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    history = [s for s in scans if "total_jobs" in s]
    assert len(history) == 1
    assert not re.search("company_name|monthly_fee|salesperson|contract", history[0])


def test_latest_scan_is_pruned_to_its_month(clean):
    for frame in (snapshots.latest_snapshot(clean), snapshots.previous_snapshot(clean)):
        assert re.search(r"PartitionFilters: \[[^\]]*snapshot_month#\d+ = Subquery", plan(frame))


def test_account_filter_reaches_the_scan(clean):
    text = plan(serving.load_monthly_usage(clean, 5))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(team_id,5\)", text)


def test_unused_columns_are_not_read(spark, clean):
    from tidemark.plans.trends import user_trend_monthly
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        text = plan(user_trend_monthly(clean))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    read = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    tie_break = {"source_file", "total_clicks_wo_api", "total_jobs"}
    assert {c.split(":")[0] for c in read.split(",")} == {
        "team_id", "is_test", "active_users"} | tie_break


@pytest.mark.parametrize("name,windows", [
    ("onboarding_count", 0), ("fee_per_latest_user", 0), ("days_display", 1), ("size_display", 1),
    ("fee_display", 1)])
def test_no_score_for_what_does_not_show_it(spark, name, windows):
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    # the panel's own running sum is one window
    assert len(re.findall(r"^.*[ -] Window \[", text, re.M)) <= windows + text.count("sum(n")
    assert "penalty" not in text


def test_ordering_does_not_run_the_windows_twice(clean):
    text = plan(at_risk_next_actions(clean))
    between = text[text.index("Exchange rangepartitioning"):text.index("Window")]
    assert "Exchange hashpartitioning(team_id" in between


def test_no_window_over_a_long_history(clean):
    """In the auto layout a history's window takes only accounts that are not long."""
    text = plan(health.overall_health_score(clean, layout="auto"))
    assert "LeftAnti" in text and "LeftSemi" in text
    assert not re.search("Cartesian|NestedLoop", text)


@pytest.mark.parametrize("name", ["overall_health_score_blocks", "at_risk_next_actions",
                                  "filter_options", "onboarding_clients"])
def test_no_python_and_no_products(spark, name):
    text = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not re.search("Python|Cartesian|NestedLoop|Pandas|Arrow", text)
