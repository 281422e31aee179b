"""Checks on the raw or clean table.  Both aggregate before they shuffle, so a hot
account or a large group of copies costs no task more than its own input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def duplicate_keys(rows: DataFrame) -> DataFrame:
    """(team_id, snapshot_month) keys with more than one row, and how many.

    The monthly views want unique keys: between rows of the same month the order, and so
    every month-on-month measure, follows from a tie-break only.  The load reports these keys.
    """
    return (rows.groupBy("team_id", "snapshot_month")
            .agg(F.count(F.lit(1)).alias("rows"))
            .where(F.col("rows") > 1))


def longest_history(rows: DataFrame) -> DataFrame:
    """One row: the largest number of rows of any account."""
    return (rows.groupBy("team_id").agg(F.count(F.lit(1)).alias("rows"))
            .agg(F.max("rows").alias("rows")))
