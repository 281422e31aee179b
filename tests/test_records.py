"""Records with line breaks in quotes, cut out of many small splits, against whole-file reading."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tidemark.rules import HEADER_TO_COLUMN
from tidemark.sources import records
from tidemark.sources.csv_files import ingest, list_files, scan_files
from tidemark.sources.raw_table import read_raw_table

HEADERS = list(HEADER_TO_COLUMN)
COLUMNS = list(HEADER_TO_COLUMN.values())


@pytest.fixture
def small_splits(spark):
    """Splits of some 600 bytes, so that a small file has many and records cross them."""
    settings = {"spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "100"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def quoted(pick, field):
    if any(c in field for c in '",\n\r') or pick.random() < 0.2:
        return '"' + field.replace('"', '""') + '"'
    return field


def text_of(pick, rows, headers, end="\n", last=True):
    lines = [",".join(quoted(pick, f) for f in row) for row in [headers, *rows]]
    return end.join(lines) + (end if last else "")


def random_rows(pick, n, long_field=0):
    def field():
        kind = pick.random()
        if kind < 0.3:
            return ""
        if kind < 0.6:
            return str(pick.randint(0, 99999))
        if kind < 0.7:
            return "".join(pick.choice('a,"\n') for _ in range(pick.randint(1, 12))).strip("\n") or "q"
        return pick.choice(["two\nlines", 'say "x", then\n"y"', "a\r\nb", "é ü", '"', "x,y", '""\n""', "\n\n\nmany"])
    rows = [[f"company {i}", str(i), *(field() for _ in HEADERS[2:])] for i in range(n)]
    if long_field:
        rows[n // 2][0] = "line\n" * long_field + "end"
        rows[n // 3][1] = '""\n' * (long_field // 2)
    return rows


def scanned(spark, root, **options):
    paths = [r["path"] for r in list_files(spark, str(root)).collect()]
    rows = scan_files(spark, paths, **options).collect()
    return sorted((r["path"].rsplit("/", 1)[1], *[r[c] or "" for c in COLUMNS]) for r in rows)


@pytest.mark.parametrize("end,last,long_field,bom", [("\n", True, 0, ""), ("\r\n", True, 0, "\ufeff"), ("\n", False, 700, ""), ("\r\n", False, 400, "")])
def test_many_splits_give_the_records_of_whole_files(spark, small_splits, tmp_path, end, last, long_field, bom):
    pick, want = random.Random(repr((end, last, long_field))), []
    (tmp_path / "uk").mkdir()
    for month in range(1, 5):
        headers = HEADERS if month % 2 else [*reversed(HEADERS), "Extra"]
        rows = random_rows(pick, 40, long_field if month < 3 else 0)
        if month == 4:  # no breaks in quotes
            rows = [[f.replace("\n", " ").replace("\r", "") for f in row] for row in rows]
        placed = [[dict(zip(HEADERS, row)).get(h, "x\ny" if month != 4 else "x") for h in headers] for row in rows]
        text = bom + text_of(pick, placed, headers, end, last)
        (tmp_path / "uk" / f"2025-0{month}.csv").write_bytes(text.encode())
        parsed = list(csv.DictReader(io.StringIO(text.lstrip("\ufeff"), newline="")))
        assert len(parsed) == 40
        want += [(f"2025-0{month}.csv", *[row[h] for h in HEADERS]) for row in parsed]
    assert scanned(spark, tmp_path) == sorted(want)
    paths = [r["path"] for r in list_files(spark, str(tmp_path)).collect()]
    lines = records.lines_of(spark, paths, F.col("_metadata.file_path"))
    splits = lines.select("path", "block").distinct().count()
    assert splits > 20 and lines.rdd.getNumPartitions() > 20
    assert records.inside_splits(lines).count() > 3


def test_one_piece_gives_the_same(spark, tmp_path):
    (tmp_path / "uk").mkdir()
    pick = random.Random(5)
    (tmp_path / "uk" / "2025-01.csv").write_bytes(text_of(pick, random_rows(pick, 30), HEADERS).encode())
    assert scanned(spark, tmp_path) == scanned(spark, tmp_path, multi_line=True)


def brute_ends(line, inside):
    """The same by one character at a time."""
    state, i = ("in" if inside else "start"), 0
    while i < len(line):
        c = line[i]
        if state == "in":
            if c == '"':
                state = "closed"
        elif c == '"':
            state = "in" if state in ("start", "closed") else state
        else:
            state = "start" if c == "," else "field"
        i += 1
    return state == "in"


def test_ends_of_lines(spark):
    pick = random.Random(1)
    lines = ["", '"', '""', '"""', 'a"', 'a"b"c', '"a"b"', ',"', '","', '"",""', '"a""', '""a"', '"a"",']
    lines += ["".join(pick.choice('",ab') for _ in range(pick.randint(0, 14))) for _ in range(3000)]
    frame = spark.createDataFrame([(line,) for line in lines], "line string").select(
        "line", records.ends_quoted(F.col("line"), False).alias("out"), records.ends_quoted(F.col("line"), True).alias("inside"))
    for row in frame.collect():
        assert (row["out"], row["inside"]) == (brute_ends(row["line"], False), brute_ends(row["line"], True)), row["line"]


def test_quotes_that_open_no_field(spark, small_splits, tmp_path):
    """A quote within a field is a character, also next to a field with a break."""
    (tmp_path / "uk").mkdir()
    rows = [f'5" pipe,{i},"a\nb",7" x' for i in range(200)]
    (tmp_path / "uk" / "2025-01.csv").write_text("\n".join([",".join(HEADERS), *rows]) + "\n")
    assert [r[1:5] for r in scanned(spark, tmp_path)] == sorted(('5" pipe', str(i), "a\nb", '7" x') for i in range(200))


def test_header_with_breaks_and_lines_that_end_in_returns(spark, tmp_path):
    (tmp_path / "uk").mkdir()
    headers = ['Extra\n"column"', *HEADERS]
    (tmp_path / "uk" / "2025-01.csv").write_text(",".join(f'"{h}"'.replace('"column"', '""column""') for h in headers) + "\nx,A,1\n\n  \nx,B,2\n")
    (tmp_path / "uk" / "2025-02.csv").write_bytes((",".join(HEADERS) + '\r"C\rD",3\rE,4\r').encode())
    assert [r[:3] for r in scanned(spark, tmp_path)] == [
        ("2025-01.csv", "A", "1"), ("2025-01.csv", "B", "2"), ("2025-02.csv", "C\nD", "3"), ("2025-02.csv", "E", "4")]


@pytest.mark.parametrize("tail,message", [('A,1,"open\nand open', "never closed"), ('"x\ny",' + ",".join("1" * 17), "too many fields")])
def test_broken_records_are_errors(spark, small_splits, tmp_path, tail, message):
    (tmp_path / "uk").mkdir()
    (tmp_path / "uk" / "2025-01.csv").write_text("\n".join([",".join(HEADERS), *['"a\nb",1'] * 100, tail]) + "\n" + "more\n" * 300)
    with pytest.raises(Exception, match=message):
        scanned(spark, tmp_path)


def test_load_of_files_with_breaks(spark, small_splits, tmp_path):
    pick = random.Random(8)
    (tmp_path / "in" / "uk").mkdir(parents=True)
    rows = [[f"two\nlines {i}", str(i), *[""] * (len(HEADERS) - 2)] for i in range(300)]
    (tmp_path / "in" / "uk" / "2025-01.csv").write_text(text_of(pick, rows, HEADERS))
    report = ingest(spark, str(tmp_path / "in"), str(tmp_path / "raw")).first()
    assert (report["rows"], report["most_rows"]) == (300, 1)
    loaded = read_raw_table(spark, str(tmp_path / "raw"))
    assert sorted(r["company_name"] for r in loaded.collect()) == sorted(r[0] for r in rows)
