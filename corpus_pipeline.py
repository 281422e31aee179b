"""From raw documents to packed training bins: five stages, each one of the text operators.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of documents; the
last one returns where each text lies. Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, line_join, packing, quality, simhash
from tidemark.llm.common import written

#: Least part of the label probabilities that the best language must have. Clean texts half in one language
#: and half in another have 0.40 to 0.55 and stay; of the 51,282 texts of check_s one goes, which repeats one
#: nonsense word. A mix of all four languages has 0.29, words of random letters have 0.41.
LANGUAGE_SHARE = 0.38


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those in which no language stands out.

    The model learns from the language labels in ``docs``; without any, only texts without letters go.
    """
    return langid.keep(docs, langid.fit(langid.sample(docs)), LANGUAGE_SHARE)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose score, learned from the labels of ``docs``, is below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fit(*quality.sample(docs, labels)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that match an earlier line, and texts of which nothing but them was left."""
    found = line_join.dedup(docs)
    emptied = (F.size("removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    changed = F.when(F.size("removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", changed).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group of near-duplicates."""
    return simhash.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each text lies: (doc_id, piece, size, bin, start)."""
    return packing.best_fit(docs)


STAGES = [
    ("language", language), ("quality", good_quality), ("line_dedup", line_dedup),
    ("near_dedup", near_dedup), ("packing", packed),
]

#: Learned models and best-fit order are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
