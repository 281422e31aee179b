"""The account timeline kept from month to month.

A new month changes little of a history: its own rows come in, and a streak that it ends gets its end.
What else is counted from the newest row (rows from here, last month, fee and users) belongs to the
account. So the timeline is kept in three parts:

* ``settled``: rows whose nearest breaks are known for all signals; never touched again;
* ``open``: rows of streaks that go on; the only ones a new month revises;
* ``state``: per account the number of its rows, its first and newest month, its last three rows,
  and for each signal its breaks so far and the position of the last one.

``advance`` takes in the rows of later months with the last two alone, and ``completed`` joins rows
with their account's state, which gives the columns of ``history.account_timeline``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.history import (
    LOOK_BACK_ROWS, ROW_ORDER, SIGNALS, Bounds, account_timeline, break_position, by_month, is_break,
    newest_first, settled_layout, tie_break, up_to_here, with_signals, with_streaks)

# What look-back measures and the order of rows read.
_TAIL = ["snapshot_month", ROW_ORDER, "total_clicks_wo_api", "active_users", "total_jobs"]
_NEWEST = {"last_month": "snapshot_month", "last_monthly_fee": "monthly_fee", "last_active_users": "active_users"}


def begun(clean: DataFrame, layout: str | Bounds = "auto") -> tuple[DataFrame, DataFrame]:
    """(rows, state) of a whole history, from its timeline; rows without an account id stay out."""
    timeline = account_timeline(clean.where(F.col("team_id").isNotNull()), settled_layout(clean, layout))
    state = _summary(timeline.withColumn(ROW_ORDER, tie_break()), F.col("rows_from_here"))
    of_account = {"first_seen_month", "rows_from_here", *_NEWEST, *[f"{s}_{c}" for s in SIGNALS for c in ("streak", "streak_so_far")]}
    return timeline.withColumn("position", F.col("position").cast("bigint")).drop(*of_account), state


def advance(state: DataFrame, open_rows: DataFrame, later: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, state): the rows that are new or were open, and the accounts' new state.

    ``later``: clean rows of whole months after all those of ``state``, some months at most; an
    account's rows in them go to one task. Rows without an account id stay out.
    """
    later = later.where(F.col("team_id").isNotNull())
    rows = later.withColumn(ROW_ORDER, tie_break())
    lead_in = (state.join(later.select("team_id").distinct(), "team_id", "left_semi")
               .select("team_id", F.explode("tail").alias("row")).select("team_id", "row.*")
               .withColumn("is_lead_in", F.lit(True)))
    rows = rows.withColumn("is_lead_in", F.lit(False)).unionByName(lead_in, allowMissingColumns=True)
    rows = _placed(with_signals(rows, ["team_id"]).where(~F.col("is_lead_in")).drop("is_lead_in"))
    carried = state.select("team_id", F.col("rows").alias("carried_rows"), *[
        F.col(f"{s}_{c}").alias(f"carried_{s}_{c}") for s in SIGNALS for c in ("breaks", "last_break")])
    rows = _after(rows.join(carried, "team_id", "left"))
    from_end = F.row_number().over(Window.partitionBy("team_id").orderBy(F.desc("position")))
    new_state = _merged(state, _summary(rows.withColumn("from_end", from_end), F.col("from_end")))
    stored = rows.drop(ROW_ORDER)
    ends = rows.groupBy("team_id").agg(*[
        F.min(F.when(is_break(s), F.col("position"))).alias(f"{s}_ended") for s in SIGNALS])
    revised = open_rows.join(ends, "team_id", "left").withColumns({
        f"{s}_break_after": F.coalesce(f"{s}_break_after", f"{s}_ended") for s in SIGNALS})
    return revised.select(*stored.columns).unionByName(stored), new_state


def is_open() -> Column:
    """Whether a streak of the row still goes on."""
    goes_on = F.lit(False)
    for s in SIGNALS:
        goes_on = goes_on | F.col(f"{s}_break_after").isNull()
    return goes_on


def completed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Settled and open rows as the account timeline."""
    account = state.select("team_id", "rows", "first_seen_month", *_NEWEST)
    joined = rows.join(account, "team_id").withColumn("rows_from_here", F.col("rows") - F.col("position") + 1)
    return with_streaks(joined.drop("rows"))


def _placed(rows: DataFrame) -> DataFrame:
    """Positions, breaks and nearest breaks among the new rows of each account."""
    keys = ["team_id"]
    rows = rows.withColumn("position", F.row_number().over(by_month(keys)).cast("bigint"))
    forward, backward = up_to_here(by_month(keys)), up_to_here(newest_first(keys))
    return rows.withColumns({
        name: column
        for s in SIGNALS
        for name, column in (
            (f"{s}_breaks", F.sum(is_break(s).cast("int")).over(by_month(keys))),
            (f"{s}_break_before", F.max(break_position(s)).over(forward)),
            (f"{s}_break_after", F.min(break_position(s)).over(backward)),
        )
    })


def _after(rows: DataFrame) -> DataFrame:
    """The same counted from the account's first row."""
    before = F.coalesce(F.col("carried_rows"), F.lit(0))
    columns = {"position": F.col("position") + before}
    for s in SIGNALS:
        columns[f"{s}_breaks"] = F.col(f"{s}_breaks") + F.coalesce(F.col(f"carried_{s}_breaks"), F.lit(0))
        columns[f"{s}_break_before"] = F.coalesce(F.col(f"{s}_break_before") + before, F.col(f"carried_{s}_last_break"))
        columns[f"{s}_break_after"] = F.col(f"{s}_break_after") + before
    return rows.withColumns(columns).drop(*[c for c in rows.columns if c.startswith("carried_")])


def _summary(rows: DataFrame, from_end: Column) -> DataFrame:
    newest = F.max_by(F.struct(*_NEWEST.values()), "position")
    tail = F.when(from_end <= LOOK_BACK_ROWS, F.struct("position", F.struct(*_TAIL).alias("row")))
    found = rows.groupBy("team_id").agg(
        F.max("position").alias("rows"), F.min("snapshot_month").alias("first_seen_month"),
        newest.alias("newest"), F.array_sort(F.collect_list(tail)).alias("tail"),
        *[a for s in SIGNALS for a in (
            F.max(f"{s}_breaks").alias(f"{s}_breaks"), F.max(f"{s}_break_before").alias(f"{s}_last_break"))])
    return found.select(
        "team_id", "rows", "first_seen_month", *[F.col("newest")[c].alias(n) for n, c in _NEWEST.items()],
        F.col("tail.row").alias("tail"), *[f"{s}_{c}" for s in SIGNALS for c in ("breaks", "last_break")])


def _merged(state: DataFrame, summary: DataFrame) -> DataFrame:
    """States of all accounts: of those with new rows, both together."""
    joined = state.alias("old").join(summary.alias("new"), "team_id", "full")

    def both(column: str) -> Column:
        old, new = F.col(f"old.{column}"), F.col(f"new.{column}")
        if column == "first_seen_month":
            return F.least(old, new)
        if column == "tail":
            rows = F.concat(F.coalesce(old, F.expr("slice(new.tail, 1, 0)")), F.coalesce(new, F.expr("slice(old.tail, 1, 0)")))
            return F.slice(rows, F.greatest(F.size(rows) - LOOK_BACK_ROWS, F.lit(0)) + 1, LOOK_BACK_ROWS)
        if column in _NEWEST:  # a newest row may lack a fee
            return F.when(F.col("new.rows").isNotNull(), new).otherwise(old)
        return F.coalesce(new, old)

    return joined.select("team_id", *[both(c).alias(c) for c in state.columns if c != "team_id"])
