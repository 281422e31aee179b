"""A Spark session with the settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session_builder(app_name: str = "tidemark") -> SparkSession.Builder:
    """Adaptive execution sizes shuffles and splits skewed joins; set
    ``spark.sql.shuffle.partitions`` to about the shuffled bytes / 200 MB as its start.

    Call sites are not recorded per column expression: they only serve error messages,
    and building a plan is several times faster without.
    """
    return (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
