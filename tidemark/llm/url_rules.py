"""Judging urls by nested host/path rules: a sorted sweep over intervals of reversed-host keys.

A rule becomes one interval of binary keys: its host's labels from the last to the first, a
separator byte, its path, closed by a byte above all text. A url becomes one probe for each of
its host's suffixes that is no longer than the longest rule host. Rule intervals are nested or
disjoint, so a sweep in key order needs a stack only. The stack is kept as columns: the running
sum of opens and closes is its height, and the last rule opened at the present height is its top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def url_host(url: Column) -> Column:
    """Lower-cased (A-Z) text between the first ``://`` and the next ``/``, ``?``, ``#`` or the end."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(labels: Column, path: Column) -> Column:
    """Labels of a host, last first, then the path; 0xFE occurs in no UTF-8 text."""
    host = F.concat_ws(".", labels)
    return F.concat(F.encode(host, "utf-8"), F.unhex(F.lit("FE")), F.encode(path, "utf-8"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", tasks: int | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced.

    ``rules``: (host, path, verdict) with verdict allow or block. A rule fits its host and all
    subdomains where the url's path starts with the rule's. The rule with most characters wins,
    between equals the one with the longer host. Of rules that are given twice, block wins.
    Rows with a null host, path or verdict are no rules. A null url, or one without ``://``, has
    empty host and path and gets ``default`` and a null rule, as every url without a fitting rule.

    Equal urls are judged once and joined back, so a common url costs one probe; the join has one
    row per (host, path) on one side. The sweep runs in ranges of the key, each in its own task;
    heights and stack tops at the start of each range come from one row per range and height. Urls whose
    probes have one key, as all of one path below a common suffix, are dealt out over ranges by a hash.
    The events are written once with their range, as bounds sampled anew would differ.
    """
    tasks = tasks or partitions(pages.sparkSession)
    pages = pages.drop("host", "path", "rule", "verdict")
    pages = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})

    rules = rules.filter("host is not null and path is not null and verdict is not null").groupBy(
        F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("labels", F.reverse(F.split("host", r"\.")))
    deepest = rules.agg(F.coalesce(F.max(F.size("labels")), F.lit(0)).alias("n")).scalar()
    top = F.struct(
        (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"),
        F.concat("host", "path").alias("rule"), "verdict",
    )
    nothing = F.lit(None).cast("string")
    opens = rules.select(_key(F.col("labels"), F.col("path")).alias("key"), top.alias("top"))
    opens = opens.withColumns({"step": F.lit(1), "turn": F.lit(0), "host": nothing, "path": nothing})
    closes = opens.withColumns({
        "key": F.concat("key", F.unhex(F.lit("FF"))), "step": F.lit(-1), "turn": F.lit(2),
        "top": F.lit(None).cast(opens.schema["top"].dataType),
    })

    urls = pages.select("host", "path").filter("host <> ''").distinct()
    labels = F.reverse(F.split("host", r"\."))
    levels = urls.select("host", "path", labels.alias("labels"), F.explode(
        F.sequence(F.lit(0), F.least(F.size(labels), deepest))).alias("level")).filter("level > 0")
    probes = levels.select(
        _key(F.slice("labels", F.lit(1), F.col("level")), F.col("path")).alias("key"),
        F.lit(None).cast(opens.schema["top"].dataType).alias("top"),
        F.lit(0).alias("step"), F.lit(1).alias("turn"), "host", "path")

    events = opens.unionByName(closes).unionByName(probes)
    # many urls may share a key: a third column lets the bounds lie between them
    events = events.withColumn("spread", F.xxhash64("host", "path"))
    events = events.repartitionByRange(tasks, "key", "turn", "spread").withColumn("range", F.spark_partition_id()).drop("spread")
    events = written(events)
    swept = W.partitionBy("range").orderBy("key", "turn")
    events = events.withColumn("height", F.sum("step").over(swept))
    # One row per range and height: how high the range ends, and the last rule it opens there.
    ends = events.groupBy("range").agg(F.sum("step").alias("rise"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select("range", F.coalesce(F.sum("rise").over(before), F.lit(0)).alias("base"))
    events = events.join(ends, "range").withColumn("height", F.col("height") + F.col("base")).drop("base")
    last = events.filter("step = 1").groupBy("height", "range").agg(
        F.max_by("top", "key").alias("top"))
    heights = events.groupBy("range", "height").agg(F.lit(1).alias("one")).join(last, ["height", "range"], "left")
    carried = heights.select("range", "height", F.last("top", ignorenulls=True).over(
        W.partitionBy("height").orderBy("range").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    inside = W.partitionBy("range", "height").orderBy("key", "turn")
    events = events.withColumn("top", F.last("top", ignorenulls=True).over(inside))
    probes = events.filter("turn = 1 and height > 0").join(carried, ["range", "height"], "left")
    best = probes.withColumn("top", F.coalesce("top", "carried")).groupBy("host", "path").agg(F.max("top").alias("top"))
    judged = best.select("host", "path", F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))
    return pages.join(judged, ["host", "path"], "left").withColumn(
        "verdict", F.coalesce("verdict", F.lit(default)))
