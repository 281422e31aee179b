"""Numeric column expressions whose NULL, cast and zero handling is part of the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal literal at the start of a text: sign, digits with optional point, exponent.
NUMBER_PREFIX = r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)"

# Relative distance below a rounding tie that still rounds as the tie.
TIE_TOLERANCE = 3e-16


def leading_number(text: Column) -> Column:
    """The number a text starts with; 0 when it starts with none; NULL for NULL.

    Plain digits with a point, nearly all texts, are cast without a pattern match.
    """
    plain = (text != "") & (F.translate(text, "0123456789.", "") == "")
    prefix = F.nullif(F.regexp_extract(text, NUMBER_PREFIX, 1), F.lit(""))
    return F.coalesce(F.when(plain, text.try_cast("double")), prefix.try_cast("double"),
                      F.when(text.isNotNull(), F.lit(0.0)))


def whole_number(text: Column) -> Column:
    """A count read as text: ``12`` or ``12.0``; NULL when it is no number."""
    trimmed = F.trim(text)
    return F.coalesce(trimmed.try_cast("bigint"), trimmed.try_cast("double").try_cast("bigint"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division with NULL for a zero or missing denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def change_ratio(value: Column, before: Column) -> Column:
    """Relative change from ``before`` to ``value``."""
    return ratio(value - before, before)


def strict_least(first: Column, *others: Column) -> Column:
    """Smallest argument, NULL as soon as one argument is NULL (``least`` skips NULLs)."""
    return F.when(_all_present(first, *others), F.least(first, *others))


def strict_greatest(first: Column, *others: Column) -> Column:
    """Largest argument, NULL as soon as one argument is NULL."""
    return F.when(_all_present(first, *others), F.greatest(first, *others))


def _all_present(first: Column, *others: Column) -> Column:
    present = first.isNotNull()
    for other in others:
        present = present & other.isNotNull()
    return present


def round_half_away(value: Column, digits: int) -> Column:
    """Decimal rounding, ties away from zero.

    A quotient that should be a tie is often stored just below it; within
    ``TIE_TOLERANCE`` of its size it still counts as one.
    """
    return F.round(value + value * F.lit(TIE_TOLERANCE), digits)


def points_by_length(length: Column, points: Sequence[int]) -> Column:
    """Table look-up by 1-based length; the last entry serves all longer lengths."""
    table = F.array(*[F.lit(p) for p in points])
    place = F.when(length > len(points), F.lit(len(points))).otherwise(length.cast("int"))
    return F.get(table, place - 1)


def at_least_band(value: Column, bounds: Sequence[tuple], otherwise) -> Column:
    """Label of the first bound (given from high to low) that ``value`` reaches."""
    return _first_match([(value >= bound, label) for bound, label in bounds], otherwise)


def at_most_band(value: Column, bounds: Sequence[tuple], otherwise) -> Column:
    """Label of the first bound (given from low to high) that ``value`` does not exceed."""
    return _first_match([(value <= bound, label) for bound, label in bounds], otherwise)


def below_band(value: Column, bounds: Sequence[tuple], otherwise) -> Column:
    """Label of the first bound (given from low to high) that ``value`` stays below."""
    return _first_match([(value < bound, label) for bound, label in bounds], otherwise)


def _first_match(cases: Sequence[tuple], otherwise) -> Column:
    (condition, label), *rest = cases
    result = F.when(condition, F.lit(label))
    for condition, label in rest:
        result = result.when(condition, F.lit(label))
    return result.otherwise(F.lit(otherwise))


def round_scaled(value: Column, digits: int) -> Column:
    """Rounding as numpy does it: scale up, nearest even integer, scale down."""
    scale = F.lit(float(10 ** digits))
    return F.rint(value * scale) / scale


def round_exact(value: Column, digits: int) -> Column:
    """Rounding of a stored double of 0 to 100, ties to even, decided on its exact binary value.

    A double from 1/32 on is a whole number of 2 to the -57; smaller ones only round to 0 in the
    one or two digits this is for. Splitting off the integer part keeps each half exact.
    """
    unit = F.lit(2**57).cast("decimal(18,0)")
    units = (F.floor(value).cast("decimal(3,0)") * unit
             + F.floor((value - F.floor(value)) * float(2**57)).cast("decimal(18,0)"))
    scaled = units * F.lit(10**digits).cast("decimal(3,0)")
    place = F.floor(scaled / unit).cast("bigint")
    place = F.when(place.cast("decimal(5,0)") * unit > scaled, place - 1).otherwise(place)
    rest = (scaled - place.cast("decimal(5,0)") * unit) * 2
    up = (rest > unit) | ((rest == unit) & (place % 2 == 1))
    return (place + F.when(up, 1).otherwise(0)).cast("double") / (10**digits)
