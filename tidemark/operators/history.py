"""The account timeline: every month-on-month measure of an account in one pass.

All measures look along one account's months, so one shuffle by ``team_id`` serves
them all; the views are projections of this frame and Spark drops the window
columns a view does not use.

An account has one row per month (``operators.checks`` finds violations), so its
history is bounded by the number of months and one window group is small: that is the
``window`` layout.  ``auto`` does not rely on it: accounts with more rows than a fair task
takes, and rows without an account id, go through ``operators.blocks``, where no task holds
more than some rows of a history.  Which rows those are is part of the plan, so building a
frame runs no job.  Rows of one account and month are in a fixed order (``tie_break``), the
same in all layouts.

Columns added
    clicks_per_user, prev_month, prev_active_users, prev_clicks_per_user, jobs_posted,
    clicks_per_user_change, user_pct_change, jobs_pct_change, clicks_per_user_3m_avg,
    engagement_delta, worst_3m_pct_change, first_seen_month,
    last_month, last_monthly_fee, last_active_users (the account's newest row), and for
    each signal s in SIGNALS: {s}_declining, {s}_breaks, {s}_streak_so_far, {s}_streak.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.numbers import change_ratio, ratio, round_half_away
from tidemark.operators.facts import facts_of

SIGNALS = ("engagement", "user", "jobs")

# No measure looks further back than this many rows (rolling average of the row before).
LOOK_BACK_ROWS = 3

# Column that holds the tie-break while a timeline is built: a column, as windows that order
# by the same columns share a sort.
ROW_ORDER = "row_order"


@dataclass(frozen=True)
class Bounds:
    """The ``auto`` layout's limits: an account with more rows than ``history_rows``, and than
    one in ``accounts`` of all rows, is cut into blocks of about ``block_rows``.

    At most ``accounts`` accounts can be that long, so their ids, 8 MB of them, may be broadcast.
    Of 10**12 rows a history of a million is cut, so a window group stays within some 100 MB.
    ``long_accounts`` names the accounts to cut; without it they are counted.
    """

    history_rows: int = 100_000
    block_rows: int = 50_000
    accounts: int = 1_000_000
    long_accounts: tuple[int, ...] | None = None


def settled_layout(clean: DataFrame, layout: str | Bounds) -> str | Bounds:
    """``auto`` made more definite by what the ledger of ``clean`` tells: ``window`` where no history is
    long, else, where it names all accounts that may be, these."""
    facts = facts_of(clean)
    if facts is None or layout in ("window", "blocks") or (isinstance(layout, str) and layout != "auto"):
        return layout
    bounds = Bounds() if layout == "auto" else layout
    if facts.longest <= bounds.history_rows:
        return "window"
    found = facts.longer_than(bounds.history_rows)
    return layout if found is None or bounds.long_accounts is not None else replace(bounds, long_accounts=found)


def account_timeline(clean: DataFrame, layout: str | Bounds = "window") -> DataFrame:
    """Clean rows with the timeline columns; ``layout`` is ``window``, ``blocks``, ``auto`` or
    the ``Bounds`` of an ``auto`` layout."""
    from tidemark.operators.blocks import blocked_timeline, long_accounts
    layout = settled_layout(clean, layout)
    if layout == "blocks":
        return blocked_timeline(clean)
    if layout == "window":
        return _in_windows(clean.withColumn(ROW_ORDER, tie_break()))
    if layout != "auto" and not isinstance(layout, Bounds):
        raise ValueError(f"unknown layout {layout!r}")
    bounds = Bounds() if layout == "auto" else layout
    known = clean.where(F.col("team_id").isNotNull())
    if bounds.long_accounts is None:
        long = F.broadcast(long_accounts(known, bounds))
    else:
        long = F.broadcast(clean.sparkSession.createDataFrame([(i,) for i in bounds.long_accounts], "team_id bigint"))
    rest = known.join(long, "team_id", "left_semi").unionByName(
        clean.where(F.col("team_id").isNull()))
    short = known.join(long, "team_id", "left_anti").withColumn(ROW_ORDER, tie_break())
    if bounds.long_accounts is None:  # a table with a ledger may have its rows in buckets by account
        short = dealt(short, ["team_id"])
    return _in_windows(short).unionByName(blocked_timeline(rest, bounds.block_rows))


def _in_windows(ordered: DataFrame) -> DataFrame:
    return with_streaks(with_positions(with_signals(ordered, ["team_id"]))).drop(ROW_ORDER)


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by ``keys`` in twice the session's shuffle partitions.

    Adaptive execution merges partitions by shuffled bytes, of which rows take some 30 times as
    much in the windows' sorts; it leaves those asked for by number.  Twice, as Spark drops a
    shuffle that deals like the one below it, whose partitions it then merges.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(2 * partitions, *keys)


def tie_break() -> Column:
    """Order of rows of one account and month: by a hash of where they come from and of what
    the measures look at.  Rows that agree in all of it are interchangeable."""
    return F.xxhash64("region", "source_file", "total_clicks_wo_api", "active_users", "total_jobs")


def by_month(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("snapshot_month", ROW_ORDER)


def newest_first(keys: list[str]) -> WindowSpec:
    """By ``position``, so that copies of a row stand in the same order both ways."""
    return Window.partitionBy(*keys).orderBy(F.desc("position"))


def up_to_here(order: WindowSpec) -> WindowSpec:
    return order.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_signals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row-level measures that need at most ``LOOK_BACK_ROWS`` earlier rows."""
    order = by_month(keys)
    last_three = order.rowsBetween(-2, Window.currentRow)

    def before(name: str) -> Column:
        return F.lag(name).over(order)

    per_user = round_half_away(ratio(F.col("total_clicks_wo_api"), F.col("active_users")), 2)
    return (
        rows
        .withColumn("clicks_per_user", per_user)
        .withColumns({
            "prev_month": before("snapshot_month"),
            "prev_active_users": before("active_users"),
            "prev_clicks_per_user": before("clicks_per_user"),
            "jobs_posted": F.coalesce(F.col("total_jobs") - before("total_jobs"), F.lit(0)),
            "clicks_per_user_3m_avg": F.avg("clicks_per_user").over(last_three),
        })
        .withColumns({
            "clicks_per_user_change": change_ratio(
                F.col("clicks_per_user"), F.col("prev_clicks_per_user")),
            "user_pct_change": change_ratio(F.col("active_users"), F.col("prev_active_users")),
            "jobs_pct_change": change_ratio(F.col("jobs_posted"), before("jobs_posted")),
            "engagement_delta":
                F.col("clicks_per_user_3m_avg") - before("clicks_per_user_3m_avg"),
        })
        .withColumns({
            "worst_3m_pct_change": F.min("user_pct_change").over(last_three),
            # the engagement change counts at four digits, the other two as they are
            "engagement_declining": _negative(round_half_away(F.col("clicks_per_user_change"), 4)),
            "user_declining": _negative(F.col("user_pct_change")),
            "jobs_declining": _negative(F.col("jobs_pct_change")),
        })
    )


def _negative(change: Column) -> Column:
    return F.coalesce(change < 0, F.lit(False))


def with_positions(rows: DataFrame) -> DataFrame:
    """Where each row stands in its account, and where the nearest streak breaks are.

    A streak is the run of declining rows between two breaks.  Knowing the position of
    the break before and of the break after a row gives its length, so the three signals
    share one ascending and one descending sort instead of one sort per signal.
    """
    keys = ["team_id"]
    forward, backward = up_to_here(by_month(keys)), up_to_here(newest_first(keys))
    rows = rows.withColumns({
        "position": F.row_number().over(by_month(keys)),
        "first_seen_month": F.min("snapshot_month").over(forward),
    })
    rows = rows.withColumns({
        name: column
        for s in SIGNALS
        for name, column in (
            (f"{s}_breaks", F.sum(is_break(s).cast("int")).over(by_month(keys))),
            (f"{s}_break_before", F.max(break_position(s)).over(forward)),
        )
    })
    return rows.withColumns({
        "rows_from_here": F.row_number().over(newest_first(keys)),
        "last_month": F.first("snapshot_month").over(backward),
        "last_monthly_fee": F.first("monthly_fee").over(backward),
        "last_active_users": F.first("active_users").over(backward),
        **{f"{s}_break_after": F.min(break_position(s)).over(backward) for s in SIGNALS},
    })


def is_break(signal: str) -> Column:
    return ~F.col(f"{signal}_declining")


def break_position(signal: str) -> Column:
    return F.when(is_break(signal), F.col("position"))


def with_streaks(rows: DataFrame) -> DataFrame:
    """Streak lengths from the positions of the breaks around a declining row.

    ``{s}_streak`` is the length of the whole streak, later months included;
    ``{s}_streak_so_far`` counts up to the row.  On an account's newest row both agree.
    """
    one_past_end = F.col("position") + F.col("rows_from_here")
    lengths = {}
    for s in SIGNALS:
        declining = F.col(f"{s}_declining")
        start = F.coalesce(F.col(f"{s}_break_before"), F.lit(0))
        end = F.coalesce(F.col(f"{s}_break_after"), one_past_end)
        lengths[f"{s}_streak_so_far"] = F.when(
            declining, (F.col("position") - start).cast("bigint"))
        lengths[f"{s}_streak"] = F.when(declining, (end - start - 1).cast("bigint"))
    return rows.withColumns(lengths)
