"""Text forms of values for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import rules


def fee_text(fee: Column, region: Column) -> Column:
    """Fee cut to whole units, with thousands commas and the region's currency sign."""
    sign = F.lit(rules.CURRENCY_OTHER)
    for name, symbol in rules.CURRENCY_BY_REGION.items():
        sign = F.when(region == name, F.lit(symbol)).otherwise(sign)
    amount = F.format_number(fee.cast("bigint"), 0)
    return F.when(fee.isNull(), F.lit(rules.FEE_UNKNOWN)).otherwise(F.concat(sign, amount))


def days_text(days: Column) -> Column:
    return F.coalesce(days.cast("string"), F.lit(rules.DAYS_UNKNOWN))


def capitalised(text: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2_000_000_000)))
