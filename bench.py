"""Times the headline queries and prints one JSON line.

The raw table is written once, in a few files, from the tables in ``$BENCH_SF_DIR`` (that is
the ``fixture_panel`` time).  Every run of a query then builds its plan anew, reads the table
from disk and sends all result rows to a sink that keeps nothing; a figure is the median of
the warm runs.

    BENCH_SF_DIR   tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local threads (default 8)
    BENCH_RUNS     warm runs per query (default 3)
    BENCH_TIMES    copies of every account, for scale checks (default 1)
    BENCH_ONLY     comma-separated query names (default all)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from uuid import uuid4
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import accounts, health, serving, trends
from tidemark.plans.snapshots import clients_clean, growth_summary
from tidemark.rules import HEADER_TO_COLUMN
from tidemark.session import session_builder
from tidemark.sources.csv_files import ingest
from tidemark.sources.panel import AS_OF, panel, write_csv_files
from tidemark.sources.raw_table import load_rows, read_raw_table
from tidemark.sources.timeline_table import update_timeline

HEADLINE = ["overall_health_score", "at_risk_next_actions", "load_monthly_usage"]


def by_separate_joins(clean: DataFrame) -> DataFrame:
    """The score from one frame per penalty, joined on account and month: what the fused
    timeline saves is the difference to ``overall_health_score``."""
    keys = ["team_id", "snapshot_month"]
    return (
        clean.select(*keys, "company_name")
        .join(trends.engagement_penalty_monthly(clean).drop("decline_streak_length"), keys, "left")
        .join(trends.user_monthly_penalty(clean).select(*keys, "user_penalty"), keys, "left")
        .join(trends.user_sharp_decline_penalty(clean).select(*keys, "sharp_decline_penalty"),
              keys, "left")
        .join(trends.jobs_posted_penalty_monthly(clean).select(*keys, "jobs_posted_penalty"),
              keys, "left")
        .join(trends.pricing_exposure_monthly(clean).select(*keys, "fee_per_user"), keys, "left")
    )


QUERIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "clients_clean": lambda clean: clean,
    "growth_summary": growth_summary,
    "overall_health_score": health.overall_health_score,
    "overall_health_score_blocks": lambda c: health.overall_health_score(c, layout="blocks"),
    "overall_health_score_by_joins": by_separate_joins,
    "health_score_monthly_enriched": health.health_score_monthly_enriched,
    "at_risk_next_actions": lambda c: accounts.at_risk_next_actions(c, AS_OF),
    "onboarding_clients": accounts.onboarding_clients,
    "overall_health_score_auto": lambda c: health.overall_health_score(c, layout="auto"),
    "load_companies": lambda c: serving.load_companies(c, layout="window"),
    "load_monthly_usage": lambda c: serving.load_monthly_usage(c, layout="window"),
    "load_latest_health_summary": lambda c: serving.load_latest_health_summary(c, layout="window"),
}


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def seconds(action: Callable[[], object]) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def multiplied(raw: DataFrame, times: int) -> DataFrame:
    """Every account ``times`` times under new ids."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    return (raw.withColumn("copy", copies)
            .withColumn("team_id", F.col("team_id") * times + F.col("copy")).drop("copy"))


def measure(spark: SparkSession, sf_dir: str, runs: int, times: int,
            only: set[str]) -> tuple[dict[str, float], int]:
    base = spark.conf.get("spark.checkpoint.dir", None)
    folder = f"{base.rstrip('/')}/run-{uuid4().hex}" if base else tempfile.mkdtemp(prefix="run-", dir="/tmp")
    table = f"{folder}/clients_raw"
    source = multiplied(panel(spark, sf_dir), times) if times > 1 else panel(spark, sf_dir)
    taken = {"fixture_panel": seconds(lambda: source.write.parquet(table))}
    raw = spark.read.parquet(table)
    rows = raw.count()
    for name, build in QUERIES.items():
        if only and name not in only:
            continue

        def query() -> None:
            run(build(clients_clean(raw)))

        query()
        taken[name] = statistics.median(seconds(query) for _ in range(runs))
    # the same from the library's own table, by month and region, and by account within them
    for kind, buckets in (("partitioned", 0), ("buckets", 8)):
        if only and kind not in only:
            continue
        stored = f"{folder}/clients_raw_{kind}"
        taken[f"load_{kind}"] = seconds(lambda: load_rows(raw.repartition("snapshot_month", "region"), stored, buckets=buckets))
        for name in ("overall_health_score_auto", "at_risk_next_actions", "growth_summary", "load_monthly_usage"):
            def query() -> None:
                run(QUERIES[name](clients_clean(read_raw_table(spark, stored))))
            query()
            taken[f"{name}_{kind}"] = statistics.median(seconds(query) for _ in range(runs))
    if not only or "timeline" in only:
        stored, kept, month = f"{folder}/clients_raw_monthly", f"{folder}/timeline", F.col("snapshot_month")
        newest = raw.agg(F.max("snapshot_month")).first()[0]
        for name, part in (("timeline_begun", raw.where(month < newest)), ("timeline_month_added", raw.where(month == newest))):
            load_rows(part.repartition("snapshot_month", "region"), stored)
            taken[name] = seconds(lambda: update_timeline(spark, stored, kept))
    if times == 1 and (not only or "ingest_first" in only):
        headers = [F.col(c).alias(h) for h, c in HEADER_TO_COLUMN.items()]
        write_csv_files(panel(spark, sf_dir), headers, f"{folder}/drop")
        target = f"{folder}/ingested"
        for name in ("ingest_first", "ingest_again"):
            taken[name] = seconds(lambda: run(ingest(spark, f"{folder}/drop", target)))
    return taken, rows


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    spark = (session_builder("tidemark-bench").master(f"local[{cpus}]")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    taken, rows = measure(spark, sf_dir, int(os.environ.get("BENCH_RUNS", "3")),
                    int(os.environ.get("BENCH_TIMES", "1")), only)
    spark.stop()
    print(json.dumps({
        "metric": "account health headline queries, median warm run",
        "value": round(sum(taken.get(q, 0.0) for q in HEADLINE), 3), "unit": "sec",
        "queries": {name: round(value, 3) for name, value in taken.items()},
        "raw_rows": rows,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)
        if os.path.basename(sf_dir.rstrip("/")).startswith("sf") else sf_dir,
    }), flush=True)


if __name__ == "__main__":
    sys.exit(main())
