"""What is known of a frame without reading its rows.

A frame read from a table with a ledger has facts, and so have its clean rows. Any other frame made
from them (a filter, a join) has none, and its answers come from its rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Facts:
    """The two newest months with rows that count (None where there is none), a bound on the number
    of rows of any account, rows without an account id taken as one, and bounds of single accounts:
    ``busy`` has those that can have many rows, ``others`` holds for all that it does not name."""

    latest: str | None
    previous: str | None
    longest: int
    busy: dict[int, int] = field(default_factory=dict)
    others: int | None = None

    def longer_than(self, rows: int) -> tuple[int, ...] | None:
        """Accounts that may have more rows than that; None where the bounds do not tell."""
        if self.others is None or self.others > rows:
            return None
        return tuple(sorted(i for i, n in self.busy.items() if n > rows))


_KNOWN: WeakKeyDictionary[DataFrame, Facts] = WeakKeyDictionary()


def facts_of(frame: DataFrame) -> Facts | None:
    return _KNOWN.get(frame)


def with_facts(frame: DataFrame, facts: Facts | None) -> DataFrame:
    """The same frame, which from now on has these facts."""
    if facts is not None:
        _KNOWN[frame] = facts
    return frame
