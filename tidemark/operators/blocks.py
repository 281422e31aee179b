"""The account timeline for histories too long for one task.

The history is cut into blocks of about equally many rows: whole months, or parts of a
month that has too many rows itself.  Each block also gets the last rows before it, so all
look-back measures come out inside the block.  What crosses blocks (row positions, the nearest streak break, first and newest
month) is carried through a frame with one row per block.  Every step is a plain join,
aggregate or window; the largest window group is one block, or one account's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.history import (
    LOOK_BACK_ROWS, ROW_ORDER, SIGNALS, Bounds, break_position, by_month, dealt, is_break,
    newest_first, tie_break, up_to_here, with_signals, with_streaks)

BLOCK_KEYS = ["team_id", "block"]

# What look-back measures and the order of rows read.
_WINDOW_COLUMNS = ["snapshot_month", ROW_ORDER, "total_clicks_wo_api", "active_users",
                   "total_jobs"]


# Parts of one month never reach this many.
_PARTS = 1 << 20


def long_accounts(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """Ids of the accounts that the ``auto`` layout cuts, from counts made before the shuffle."""
    counts = rows.groupBy("team_id").agg(F.count(F.lit(1)).alias("rows"))
    fair = counts.agg((F.sum("rows") / bounds.accounts).alias("fair")).scalar()
    return counts.where((F.col("rows") > bounds.history_rows) & (F.col("rows") > fair)).select("team_id")


def with_blocks(clean: DataFrame, block_rows: int) -> DataFrame:
    """Rows (with ``ROW_ORDER``) with their ``block``: it grows with the order of rows within an account.

    A month begins in the block that its first row falls into.  A month of more rows than a
    block is dealt out over parts of its own by the tie-break, a hash, so parts are even
    unless rows are copies of each other.
    """
    months = clean.groupBy("team_id", "snapshot_month").agg(F.count(F.lit(1)).alias("month_rows"))
    before = Window.partitionBy("team_id").orderBy("snapshot_month").rowsBetween(
        Window.unboundedPreceding, -1)
    started = F.floor(F.coalesce(F.sum("month_rows").over(before), F.lit(0)) / block_rows)
    months = months.select("team_id", "snapshot_month", (started * _PARTS).alias("started"),
                           F.ceil(F.col("month_rows") / block_rows).alias("parts"))
    same = (F.col("rows.team_id").eqNullSafe(F.col("months.team_id"))
            & F.col("rows.snapshot_month").eqNullSafe(F.col("months.snapshot_month")))
    # the hash as a number from 0 to 1, growing with it
    share = (F.col(ROW_ORDER).cast("double") + 2.0**63) / 2.0**64
    part = F.when(F.col("parts") > 1, F.least(F.floor(share * F.col("parts")), F.col("parts") - 1) + 1)
    return clean.alias("rows").join(months.alias("months"), same).select(
        "rows.*", (F.col("started") + F.coalesce(part, F.lit(0))).alias("block"))


def blocked_timeline(clean: DataFrame, block_rows: int = Bounds.block_rows,
                     block: Column | None = None) -> DataFrame:
    """Same rows and columns as the one-window timeline.

    A ``block`` given must not decrease in the order of an account's rows.
    """
    clean = clean.withColumn(ROW_ORDER, tie_break())
    blocks = with_blocks(clean, block_rows) if block is None else clean.withColumn("block", block)
    rows = with_signals(dealt(_with_lead_in(blocks), BLOCK_KEYS), BLOCK_KEYS).where(~F.col("is_lead_in"))
    rows = _with_local_positions(rows.drop("is_lead_in"))
    carried = _carried_over(_block_summary(rows))
    same_block = (F.col("rows.team_id").eqNullSafe(F.col("carried.team_id"))
                  & F.col("rows.block").eqNullSafe(F.col("carried.block")))
    joined = rows.alias("rows").join(carried.alias("carried"), same_block).select(
        "rows.*", *[F.col(f"carried.{c}") for c in carried.columns if c not in BLOCK_KEYS])
    return with_streaks(_with_global_positions(joined)).drop(
        "block", ROW_ORDER, *[c for c in carried.columns if c.startswith("carried_")])


def _with_lead_in(blocks: DataFrame) -> DataFrame:
    """Every block preceded by the account's last rows before it, marked ``is_lead_in``."""
    tail = (
        blocks.select(*BLOCK_KEYS, *_WINDOW_COLUMNS)
        .withColumn("from_end", F.row_number().over(
            Window.partitionBy(*BLOCK_KEYS).orderBy(F.desc("snapshot_month"), F.desc(ROW_ORDER))))
        .where(F.col("from_end") <= LOOK_BACK_ROWS)
        .withColumn("row", F.struct("team_id", *_WINDOW_COLUMNS))
        .groupBy(*BLOCK_KEYS)
        .agg(F.sort_array(F.collect_list(F.struct(-F.col("from_end"), "row"))).alias("tail"))
    )
    along = Window.partitionBy("team_id").orderBy("block")
    nothing = F.expr("slice(tail, 1, 0)")
    # each earlier block holds at least one row, so that many blocks are enough
    earlier = F.concat(*[F.coalesce(F.lag("tail", n).over(along), nothing)
                         for n in range(LOOK_BACK_ROWS, 0, -1)])
    lead_in = (
        tail.withColumn("earlier", earlier)
        .select("block", F.explode(_last(F.col("earlier"))).alias("item"))
        .select("item.row.*", "block")
        .withColumn("is_lead_in", F.lit(True))
    )
    return blocks.withColumn("is_lead_in", F.lit(False)).unionByName(
        lead_in, allowMissingColumns=True)


def _last(items: Column) -> Column:
    start = F.greatest(F.size(items) - LOOK_BACK_ROWS, F.lit(0)) + 1
    return F.slice(items, start, LOOK_BACK_ROWS)


def _with_local_positions(rows: DataFrame) -> DataFrame:
    forward, backward = up_to_here(by_month(BLOCK_KEYS)), up_to_here(newest_first(BLOCK_KEYS))
    rows = rows.withColumn("position", F.row_number().over(by_month(BLOCK_KEYS)))
    return rows.withColumns({
        name: column
        for s in SIGNALS
        for name, column in (
            (f"{s}_breaks", F.sum(is_break(s).cast("int")).over(by_month(BLOCK_KEYS))),
            (f"{s}_break_before", F.max(break_position(s)).over(forward)),
            (f"{s}_break_after", F.min(break_position(s)).over(backward)),
        )
    })


def _block_summary(rows: DataFrame) -> DataFrame:
    per_signal = [
        aggregate
        for s in SIGNALS
        for aggregate in (
            F.count_if(is_break(s)).alias(f"{s}_breaks"),
            F.min(break_position(s)).alias(f"{s}_first_break"),
            F.max(break_position(s)).alias(f"{s}_last_break"),
        )
    ]
    newest = F.max_by(F.struct("snapshot_month", "monthly_fee", "active_users"),
                      F.col("position"))
    return rows.groupBy(*BLOCK_KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.min("snapshot_month").alias("first_month"),
        newest.alias("newest"), *per_signal)


def _carried_over(summary: DataFrame) -> DataFrame:
    """Per block, what the account's other blocks contribute to its rows."""
    along = Window.partitionBy("team_id").orderBy("block")
    against = Window.partitionBy("team_id").orderBy(F.desc("block"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    after = against.rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumns({
        "carried_rows_before": F.coalesce(F.sum("rows").over(before), F.lit(0)),
        "carried_rows_in_all": F.sum("rows").over(Window.partitionBy("team_id")),
    })

    def placed_break(name: str) -> Column:
        return F.col("carried_rows_before") + F.col(name)

    per_signal = [
        column
        for s in SIGNALS
        for column in (
            F.coalesce(F.sum(f"{s}_breaks").over(before), F.lit(0)).alias(f"carried_{s}_breaks"),
            F.last(placed_break(f"{s}_last_break"), ignorenulls=True).over(before)
            .alias(f"carried_{s}_break_before"),
            F.last(placed_break(f"{s}_first_break"), ignorenulls=True).over(after)
            .alias(f"carried_{s}_break_after"),
        )
    ]
    newest = F.first("newest").over(up_to_here(against))
    return placed.select(
        *BLOCK_KEYS, "carried_rows_before", "carried_rows_in_all",
        F.min("first_month").over(up_to_here(along)).alias("first_seen_month"),
        newest["snapshot_month"].alias("last_month"),
        newest["monthly_fee"].alias("last_monthly_fee"),
        newest["active_users"].alias("last_active_users"),
        *per_signal)


def _with_global_positions(rows: DataFrame) -> DataFrame:
    offset = F.col("carried_rows_before")
    columns = {
        "position": F.col("position") + offset,
        "rows_from_here": F.col("carried_rows_in_all") - offset - F.col("position") + 1,
    }
    for s in SIGNALS:
        columns[f"{s}_breaks"] = F.col(f"{s}_breaks") + F.col(f"carried_{s}_breaks")
        for side in ("before", "after"):
            columns[f"{s}_break_{side}"] = F.coalesce(
                F.col(f"{s}_break_{side}") + offset, F.col(f"carried_{s}_break_{side}"))
    return rows.withColumns(columns)
