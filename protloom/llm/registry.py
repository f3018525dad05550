"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, html, langid, licenses, lm, mixing, packing, prefix_trie, runs, simhash, toxicity, urls
from .common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs.select("doc_id", toxicity.held_out().alias("held_out"), "text"), model)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", lm.held_out().alias("held_out"), "text")
    return lm.score(docs, lm.train(docs.where("not held_out")))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    langs, table = langid.learn(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), langs, table)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), licenses.known(spark))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(urls.RULES), "action string, host string, path string")
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return runs.digests(runs.periodic_runs(docs.select("doc_id", runs.with_planted(F.col("text"), F.col("doc_id")).alias("text"))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.with_shared_heads(prefix_trie.numbered(read(spark, sf_dir, "conversations"))))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_lm_scoring, op4_nearest_neighbours, op5_html_extraction, op6_simhash, op7_language_id, op8_mixing, op9_license_scan, op10_url_filter, op11_periodic_runs, op12_prefix_trie, op13_packing)}

ORACLE_SQL = {
    "op9_license_scan": licenses.scan_sql(),
    "op12_prefix_trie": prefix_trie.trie_sql(),
    "op4_nearest_neighbours": """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.n <> q.n),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_url_filter": """
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
n AS (SELECT row_number() OVER () AS id, * FROM h),
m AS (SELECT id, arg_max(struct_pack(rule := rhost || rpath, action := action), length(rhost) + length(rpath)) AS best FROM n JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM n LEFT JOIN m USING (id)""",
}
