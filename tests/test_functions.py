"""Number, date and display expressions."""

import random
import sqlite3
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers
from tidemark.functions.dates import iso_from_parts, lenient_day, micros_until, whole_days
from tidemark.functions.display import capitalised, days_text, fee_text


def results(spark, values, type_name, build):
    frame = spark.createDataFrame([(v,) for v in values], f"x {type_name}")
    return [row[0] for row in frame.select(build(F.col("x"))).collect()]


def test_leading_number(spark):
    given = {"1234.5": 1234.5, "abc": 0.0, "": 0.0, "12abc": 12.0, " 7 ": 7.0, "-3e2x": -300.0,
             ".5x": 0.5, "5.": 5.0, "n/a": 0.0, "+4": 4.0, "1e": 1.0}
    assert results(spark, given, "string", numbers.leading_number) == list(given.values())
    assert results(spark, [None], "string", numbers.leading_number) == [None]


def test_leading_number_is_the_text_to_real_cast(spark):
    texts = ["7", "-7.25", "1e3", "  12.5kg", "x1", "1..2", "--1", "0x10", "1e+2z", "9" * 20]
    lite = sqlite3.connect(":memory:")
    expected = [lite.execute("select cast(? as real)", (t,)).fetchone()[0] for t in texts]
    assert results(spark, texts, "string", numbers.leading_number) == expected


def test_whole_number(spark):
    texts = ["12", " 12 ", "12.0", "-3", "1,234", "x", "", None]
    assert results(spark, texts, "string", numbers.whole_number) == [
        12, 12, 12, -3, None, None, None, None]


@pytest.mark.parametrize("digits", [0, 2, 3, 4])
def test_rounding_of_quotients(spark, digits):
    rng = random.Random(digits)
    values = [rng.randint(-4000, 4000) / rng.choice([8, 16, 37, 80, 125, 200, 384, 1600])
              for _ in range(3000)]
    values += [0.285, 1.005, 2.675, -21.874999999999996, -30.624999999999996, 9.374999999999991]
    lite = sqlite3.connect(":memory:")
    expected = [lite.execute("select round(?, ?)", (v, digits)).fetchone()[0] for v in values]
    assert results(spark, values, "double",
                   lambda x: numbers.round_half_away(x, digits)) == expected


def test_ratio_is_null_for_zero(spark):
    assert results(spark, [0, None, 4], "bigint", lambda x: numbers.ratio(F.lit(2), x)) == [
        None, None, 0.5]


def test_strict_extremes(spark):
    least = results(spark, [None, 3.0, 60.0], "double",
                    lambda x: numbers.strict_least(F.lit(50.0), x))
    greatest = results(spark, [None, -3.0, 7.0], "double",
                       lambda x: numbers.strict_greatest(F.lit(0.0), x))
    assert (least, greatest) == ([None, 3.0, 50.0], [None, 0.0, 7.0])


def test_points_by_length(spark):
    assert results(spark, [None, 1, 2, 3, 4, 5, 900], "bigint",
                   lambda x: numbers.points_by_length(x, (0, 5, 15, 30, 45))) == [
        None, 0, 5, 15, 30, 45, 45]


def test_numpy_rounding(spark):
    assert results(spark, [0.125, 0.135, 2.5, -0.125], "double",
                   lambda x: numbers.round_scaled(x, 2)) == [0.12, 0.14, 2.5, -0.12]


def test_lenient_day(spark):
    given = {"2025-01-31": date(2025, 1, 31), "2025-02-30": date(2025, 3, 2),
             "2025-04-31": date(2025, 5, 1), "2025-13-01": None, "2025-00-10": None,
             "2025-01-00": None, "2025-01-32": None, "2025-1-1": None, "--": None, "": None,
             "x": None, "0001-01-01": date(1, 1, 1)}
    assert results(spark, given, "string", lenient_day) == list(given.values())


def test_date_parts(spark):
    texts = ["06/15/2025", "31/12/2001", "", None]
    assert results(spark, texts, "string", lambda x: iso_from_parts(x, 1, 4, 7)) == [
        "2025-06-15", "2001-31-12", "--", None]


def test_days_are_cut_towards_zero(spark):
    as_of = datetime(2025, 6, 15, 12)
    days = results(spark, ["2025-06-15", "2025-06-10", "2025-07-16"], "string",
                   lambda x: whole_days(micros_until(lenient_day(x), as_of)))
    assert days == [0, -5, 30]


def test_display(spark):
    frame = spark.createDataFrame(
        [(None, "UK"), (1234567.9, "UK"), (999.0, "US"), (-1234.5, None)],
        "fee double, region string")
    shown = [r[0] for r in frame.select(fee_text(F.col("fee"), F.col("region"))).collect()]
    assert shown == ["Unknown", "£1,234,567", "$999", "$-1,234"]
    assert results(spark, [None, -4], "int", days_text) == ["Unknown. Please check", "-4"]
    assert results(spark, ["micro", None], "string", capitalised) == ["Micro", None]
