"""The driver's queries over the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import alignment, ann, centroids, decontamination, licenses, packing, passages, personal, pitman_yor, quality, simhash, toxicity, url_filters
from veritrail.llm.common import table

#: The rule list of the URL filter: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages"), url_rules(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.learned(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_word", "end_word", "match_doc_id", "match_start_word", "similarity")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda groups: F.when(groups == "", groups).otherwise(F.sha2(groups, 256))
    found = alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), carried=digest)
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal.report(personal.spans(docs, personal.learned(docs)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_quality, op3_decontamination, op4_packing, op5_license_scan, op6_substring_dedup, op7_simhash, op8_nearest, op9_lm_scores, op10_toxicity, op11_alignment, op12_centroids, op13_personal, pipeline)}


_OP1_SQL = """
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
    SELECT row_number() OVER () AS n, page_id,
        coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
hits AS (
    SELECT n, r_host || r_path AS rule, r_verdict,
        row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC, length(r_host) DESC, r_verdict DESC) AS place
    FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM hits WHERE place = 1) USING (n)
"""


def _op12_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    """All rounds written out; distances and sums over components are of integers."""
    step = """
near{r} AS MATERIALIZED (
    SELECT n, vec_id, v, cluster, distance FROM (
        SELECT n, vec_id, v, cluster, distance, row_number() OVER (PARTITION BY n ORDER BY distance, cluster) AS place FROM (
            SELECT n, vec_id, kept.v AS v, cluster, list_sum(list_transform(list_zip(kept.v, centre.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept, centre{r} AS centre))
    WHERE place = 1)"""
    move = """,
centre{s} AS MATERIALIZED (
    SELECT cluster, coalesce(moved.v, centre{r}.v) AS v FROM centre{r} LEFT JOIN (
        SELECT cluster, list((total - ((total % size) + size) % size) // size ORDER BY place) AS v FROM (
            SELECT cluster, place, sum(v[place])::HUGEINT AS total, count(*)::HUGEINT AS size FROM near{r}, range(1, 65) AS places(place) GROUP BY ALL)
        GROUP BY cluster) AS moved USING (cluster))"""
    listed = ",".join(step.replace("{r}", str(r)) + (move.replace("{r}", str(r)).replace("{s}", str(r + 1)) if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
centre0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k})),{listed},
inertias AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM near{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM near{rounds}) AS inertia,
    sha256(array_to_string(centre{rounds}.v, ',')) AS centroid_sha256
FROM near{rounds} JOIN inertias USING (cluster) JOIN centre{rounds} USING (cluster)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": _OP1_SQL, "op12_centroids": _op12_sql()}
