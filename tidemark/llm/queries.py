"""One query per operator over the whole of its table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe, interpolation, langid, lanczos_whitening, line_join, metric_tree, packing, permutation_index, piecewise, quality, simhash,
    subvector_clusters, url_rules)
from tidemark.llm.common import fold

URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.sample(docs.filter(fold("doc_id", 4) != 2)))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(*quality.sample(docs, labels.filter(fold("doc_id", 3) != 1)))
    found = quality.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op4_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_join.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "removed", F.sha2("text", 256).alias("text_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interpolation.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return found.select(
        "doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = byte_bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)


def op11_subvector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subvector_clusters.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lanczos_whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (
    op1_language, op2_quality, op3_packing, op4_piecewise, op5_line_join, op6_simhash, op7_url_rules, op8_nearest, op9_interpolation, op10_byte_bpe,
    op11_subvector_clusters, op12_metric_tree, op13_lanczos_whitening)}

_FINITE = "embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0"


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """K-means with each round as two common tables: nearest centroids, then floors of their means."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
near{i} as materialized (
  select r, n as cluster, d, row_number() over (partition by r order by d, n) as place
  from (select v.r, c.n, sum((v.x - c.x) * (v.x - c.x))::bigint as d from v join c{i} c using (dim) group by v.r, c.n)
  qualify place = 1)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} as materialized (
  select c.n, c.dim, coalesce(((s - ((s % m) + m) % m) // m)::bigint, c.x) as x
  from c{i} c left join (
    select near{i}.cluster as n, v.dim, sum(v.x) as s, count(*) as m from near{i} join v using (r) group by near{i}.cluster, v.dim) moved
  using (n, dim))""")
    return f"""
with kept as materialized (
  select row_number() over () as r, vec_id, embedding from embeddings where len(embedding) = 64 and {_FINITE}),
v as materialized (
  select r, unnest(range(64)) as dim, unnest([floor(1024 * x::double)::bigint for x in embedding]) as x from kept),
first as (
  select r, row_number() over (order by sha256('3:' || vec_id::varchar), embedding) - 1 as n from kept where vec_id is not null),
c0 as materialized (select first.n, v.dim, v.x from first join v using (r) where first.n < {k}),{",".join(steps)}
select kept.vec_id, f.cluster::int as cluster, f.d as distance, (sum(f.d) over (partition by f.cluster))::bigint as cluster_inertia,
  (sum(f.d) over ())::bigint as inertia, h.centroid_sha256
from near{rounds} f join kept using (r)
join (select n as cluster, sha256(string_agg(x::varchar, ',' order by dim)) as centroid_sha256 from c{rounds} group by n) h using (cluster)"""


SQL = {
    "op7_url_rules": """
with rules(rank, host, path, rule, verdict) as (values
  (1, 'www.example.com', '/en/', 'www.example.com/en/', 'allow'), (2, 'example.com', '/en/', 'example.com/en/', 'block'),
  (3, 'net', '/es/', 'net/es/', 'block'), (4, 'net', '/fr/', 'net/fr/', 'block'), (5, 'com', '/', 'com/', 'allow')),
rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, regexp_extract(r, '^[^/?#]*') as h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
judged as (
  select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts),
fitting as (
  select j.page_id, min_by(r.rule, r.rank) as rule, min_by(r.verdict, r.rank) as verdict
  from judged j join rules r on (j.host = r.host or ends_with(j.host, '.' || r.host)) and starts_with(j.path, r.path)
  group by j.page_id)
select j.page_id, j.host, j.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from judged j left join fitting f using (page_id)""",
    "op11_subvector_clusters": _clusters_sql(),
    "op12_metric_tree": f"""
with v as (
  select vec_id, unnest(range(len(embedding))) as dim, unnest([floor(256 * x::double)::bigint for x in embedding]) as x
  from embeddings where {_FINITE}),
scored as (
  select q.vec_id as query_id, v.vec_id, sum(q.x * v.x)::bigint as score
  from v q join v on q.dim = v.dim and q.vec_id <> v.vec_id where q.vec_id % 50 = 0 group by q.vec_id, v.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 5""",
}
