from __future__ import annotations

import pytest

from tidemark.schema import RAW_SCHEMA
from tidemark.session import session_builder


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        session_builder("tidemark-tests").master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        # tiny inputs: compiling code costs more than it saves
        .config("spark.sql.codegen.wholeStage", "false")
        # results must not depend on the session's zone
        .config("spark.sql.session.timeZone", "America/New_York")
        .getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    """Raw rows from dicts; columns not named are NULL."""
    def build(rows: list[dict]):
        return spark.createDataFrame(
            [tuple(row.get(name) for name in RAW_SCHEMA.names) for row in rows], RAW_SCHEMA)
    return build


def monthly(team_id: int, start: str = "2025-01", **series) -> list[dict]:
    """Rows of consecutive months; scalar arguments repeat."""
    length = max(len(v) for v in series.values() if isinstance(v, list))
    year, month = map(int, start.split("-"))
    rows = []
    for i in range(length):
        at = year * 12 + month - 1 + i
        row = {"team_id": team_id, "company_name": f"company {team_id}",
               "snapshot_month": f"{at // 12:04d}-{at % 12 + 1:02d}-01"}
        row.update({k: v[i] if isinstance(v, list) else v for k, v in series.items()})
        rows.append(row)
    return rows
