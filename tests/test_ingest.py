"""CSV files to raw table: names, headers, missing texts, repeated loads, the stream."""

import csv
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.rules import HEADER_TO_COLUMN
from tidemark.schema import RAW_SCHEMA
from tidemark.sources.csv_files import ingest, list_files, scan_files
from tidemark.sources.raw_table import append_rows, read_ledger, read_raw_table
from tidemark.streaming.ingest_stream import start_ingest

DAY = date(2025, 3, 4)


def write(root, name, rows, headers=None):
    headers = headers or list(HEADER_TO_COLUMN)
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(headers)
        writer.writerows([[row.get(HEADER_TO_COLUMN.get(h, h), "") for h in headers]
                          for row in rows])


@pytest.fixture
def drop(tmp_path):
    root = tmp_path / "drop"
    write(root, "uk/2025-01.csv", [
        {"company_name": 'A "x", Ltd', "team_id": 1, "monthly_fee": "1,234.50",
         "total_clicks": "12.0", "salesperson": "N/A"},
        {"company_name": "B", "team_id": 2, "monthly_fee": "n/a", "active_users": "x"}])
    write(root, "uk/2025-02.csv", [{"company_name": "A", "team_id": 1}])
    write(root, "us/2025-01.csv", [{"company_name": "Ü", "team_id": 3, "total_jobs": 7}],
          headers=["Extra", *reversed(HEADER_TO_COLUMN)])
    write(root, "z/uk/2025-01.csv", [{"company_name": "again", "team_id": 9}])
    return root


def test_load_and_load_again(spark, drop, tmp_path):
    table = str(tmp_path / "raw")
    report = ingest(spark, str(drop), table, DAY).collect()
    assert sorted((r["snapshot_month"], r["region"], r["rows"]) for r in report) == [
        ("2025-01-01", "UK", 2), ("2025-01-01", "US", 1), ("2025-02-01", "UK", 1)]
    loaded = read_raw_table(spark, table)
    assert loaded.schema == RAW_SCHEMA
    rows = {r["company_name"]: r.asDict() for r in loaded.collect()}
    assert set(rows) == {'A "x", Ltd', "B", "A", "Ü"}
    first = rows['A "x", Ltd']
    assert (first["monthly_fee"], first["total_clicks"], first["salesperson"],
            first["source_file"], first["load_date"], first["is_test"]) == (
        "1,234.50", 12, None, "uk/2025-01.csv", "2025-03-04", None)
    assert (rows["B"]["monthly_fee"], rows["B"]["active_users"]) == (None, None)
    assert (rows["Ü"]["total_jobs"], rows["Ü"]["team_id"]) == (7, 3)

    assert ingest(spark, str(drop), table, DAY).count() == 0
    write(drop, "us/2025-02.csv", [{"company_name": "C", "team_id": 4}])
    assert [r["region"] for r in ingest(spark, str(drop), table, DAY).collect()] == ["US"]
    assert read_raw_table(spark, table).count() == 5


def test_names_with_blanks_and_signs(spark, tmp_path):
    write(tmp_path / "in", "new york+50%/2025-01.csv", [{"company_name": "A", "team_id": 1}])
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "raw"))
    row = read_raw_table(spark, str(tmp_path / "raw")).first()
    assert (row["region"], row["source_file"]) == (
        "NEW YORK+50%", "new york+50%/2025-01.csv")
    assert row["load_date"] is not None


def test_a_load_that_breaks_off_repeats_itself(spark, drop, tmp_path, monkeypatch):
    from tidemark.sources import csv_files
    table = str(tmp_path / "raw")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(csv_files, "enter", killed)
        with pytest.raises(KeyboardInterrupt):
            ingest(spark, str(drop), table, DAY)
    part = next((tmp_path / "raw").glob("_data/*/snapshot_month=2025-01-01/region=UK/part-*"))
    part.unlink()  # as if the write itself had been cut short
    assert read_raw_table(spark, table).count() == 0  # what was written does not count
    assert ingest(spark, str(drop), table, DAY).count() == 3
    assert read_raw_table(spark, table).count() == 4
    assert read_ledger(spark, table).agg(F.sum("rows")).first()[0] == 4


def test_a_table_without_a_ledger_is_taken_as_loaded(spark, drop, tmp_path):
    table = str(tmp_path / "raw")
    ingest(spark, str(drop), table, DAY)
    older = str(tmp_path / "older")
    append_rows(read_raw_table(spark, table).where("region = 'UK'"), older)
    assert [r["region"] for r in ingest(spark, str(drop), older, DAY).collect()] == ["US"]
    assert read_raw_table(spark, older).count() == 4


def test_hidden_folders_and_glob_characters_are_read_and_hidden_files_reported(spark, tmp_path):
    root = tmp_path / "in"
    for name in ("a[b]/2025-01.csv", "c{d}/2025-01.csv", "_x/2025-01.csv", "uk/_2025-01.csv", "deep/.y/uk/2025-02.csv",
                 "1/2/3/4/5/6/7/_8/9/us/2025-02.csv", "_x/_z/2025-03.csv", "_x/note.txt"):
        write(root, name, [{"company_name": "A", "team_id": 1}])
    report = ingest(spark, str(root), str(tmp_path / "raw"), DAY).collect()
    assert sorted((r["region"], r["rows"], r["skipped"]) for r in report if not r["skipped"]) == [
        ("A[B]", 1, False), ("C{D}", 1, False), ("UK", 1, False), ("US", 1, False), ("_X", 1, False), ("_Z", 1, False)]
    assert [(r["region"], r["rows"]) for r in report if r["skipped"]] == [("UK", None)]
    assert read_raw_table(spark, str(tmp_path / "raw")).count() == 6
    assert ingest(spark, str(root), str(tmp_path / "raw"), DAY).where("not skipped").count() == 0


def test_what_is_no_whole_number_is_reported(spark, tmp_path):
    write(tmp_path / "in", "uk/2025-01.csv", [
        {"team_id": "1", "total_clicks": "1,234", "active_users": "12.7", "total_jobs": "5.0", "monthly_fee": "x"},
        {"team_id": "1", "total_clicks": "n/a"}, {"team_id": "2"}])
    row = ingest(spark, str(tmp_path / "in"), str(tmp_path / "raw"), DAY).first()
    assert (row["rows"], row["rejected"], row["rejected_columns"], row["duplicate_keys"]) == (
        3, 2, ["active_users", "total_clicks"], 1)
    with pytest.raises(Exception, match="no whole number in"):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "other"), DAY, strict=True)


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    def jobs(n):
        root = tmp_path / f"in{n}"
        for i in range(n):
            write(root, f"r{i}/2025-01.csv", [{"company_name": "A", "team_id": i}])
        before = newest()
        ingest(spark, str(root), str(tmp_path / f"raw{n}"), DAY)
        return newest() - before

    def newest():  # only the last thousand jobs are kept, so their ids are compared
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=-1)
    assert jobs(3) == jobs(20)


def test_batches_of_files(spark, drop, tmp_path, monkeypatch):
    from tidemark.sources import csv_files
    monkeypatch.setattr(csv_files, "FILES_PER_BATCH", 1)
    assert ingest(spark, str(drop), str(tmp_path / "raw"), DAY).count() == 3
    assert read_raw_table(spark, str(tmp_path / "raw")).count() == 4


def test_missing_header_fails(spark, tmp_path):
    write(tmp_path, "uk/2025-01.csv", [{"team_id": 1}], headers=["Team ID", "Total Clicks"])
    with pytest.raises(ValueError, match="missing columns"):
        ingest(spark, str(tmp_path), str(tmp_path / "raw"))


def test_line_breaks_in_quotes(spark, tmp_path):
    write(tmp_path / "in", "uk/2025-01.csv", [{"company_name": "two\nlines", "team_id": 1}])
    paths = [r["path"] for r in list_files(spark, str(tmp_path / "in")).collect()]
    for multi_line in (False, True):
        assert scan_files(spark, paths, multi_line=multi_line).first()["company_name"] == "two\nlines"


def test_short_rows_are_filled_and_long_rows_fail(spark, tmp_path):
    header = ",".join(HEADER_TO_COLUMN)
    for name, line in (("short", "A,1"), ("long", ",".join("1" * 18))):
        (tmp_path / name / "uk").mkdir(parents=True)
        (tmp_path / name / "uk" / "2025-01.csv").write_text(f"{header}\n{line}\n")
    short = scan_files(spark, [str(tmp_path / "short/uk/2025-01.csv")]).first()
    assert (short["company_name"], short["team_id"], short["total_jobs"]) == ("A", "1", None)
    with pytest.raises(Exception, match="too many fields"):
        scan_files(spark, [str(tmp_path / "long/uk/2025-01.csv")]).collect()


def test_nothing_to_scan(spark):
    assert scan_files(spark, []).count() == 0


def test_stream_loads_the_same(spark, drop, tmp_path):
    table, checkpoint = str(tmp_path / "raw"), str(tmp_path / "checkpoint")
    for added in (0, 1):
        if added:
            write(drop, "us/2025-03.csv", [{"company_name": "new", "team_id": 5}])
        query = start_ingest(spark, str(drop), table, checkpoint, DAY, files_per_batch=100)
        query.awaitTermination(120)
        assert query.exception() is None
        assert read_raw_table(spark, table).count() == 4 + added
    months = read_raw_table(spark, table).agg(F.countDistinct("snapshot_month")).first()[0]
    assert months == 3
