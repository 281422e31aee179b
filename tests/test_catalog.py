"""Views that follow a table's loads."""

from conftest import monthly
from tidemark.plans.catalog import follow_table, register_views, sql_to_frame
from tidemark.plans.registry import AS_OF
from tidemark.sources import raw_table
from tidemark.sources.raw_table import load_rows, read_raw_table


def test_views_follow_loads(spark, raw, tmp_path, monkeypatch):
    path = str(tmp_path / "t")

    def load(start, users):
        load_rows(raw([r | {"region": "UK"} for r in monthly(1, start, active_users=users)]), path)

    query = "select snapshot_month, active_users from latest_snapshot where team_id = ?"
    follow_table(spark, path, AS_OF)
    assert sql_to_frame(spark, query, [1]).collect() == []
    load("2025-01", [5, 6])
    assert [tuple(r) for r in spark.sql("select snapshot_month, active_users from latest_snapshot").collect()] == [("2025-02-01", 6)]
    held = sql_to_frame(spark, query, [1])
    with monkeypatch.context() as m:
        m.setattr(raw_table, "AFTER_LOAD", [])  # as when another session loads
        load("2025-03", [7])
        assert spark.sql("select count(*) from clients_raw").first()[0] == 2
    assert [tuple(r) for r in sql_to_frame(spark, query, [1]).collect()] == [("2025-03-01", 7)]
    assert spark.sql("select count(*) from monthly_usage").first()[0] == 3
    assert [tuple(r) for r in held.collect()] == [("2025-02-01", 6)]
    # views of a given frame follow nothing
    register_views(read_raw_table(spark, path), AS_OF)
    load("2025-04", [8])
    assert [tuple(r) for r in sql_to_frame(spark, query, [1]).collect()] == [("2025-03-01", 7)]
