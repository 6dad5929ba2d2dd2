"""One query for each corpus operator, over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, jaccard, langid, licenses, linededup, lm, mphf, packing, store, topk


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    return lm.log_likelihood(docs, *lm.fit(docs))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(store.table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(store.table(spark, sf_dir, "documents"), store.table(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(store.table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(store.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_dropped")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(store.table(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mphf.write_shards(store.table(spark, sf_dir, "documents")).entries()


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 50, against all rows."""
    return topk.neighbours(store.table(spark, sf_dir, "embeddings"), 10, F.col("vec_id") % 50 == 0).withColumn("distance", F.round("distance", 4))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs), keep=["doc_id", "lang"])


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(store.table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_license_scan, op3_decontamination, op4_jaccard_join, op5_line_dedup, op6_packing, op7_token_shards, op8_exact_topk, op9_language_id, op10_html_extraction)}

ORACLES = {
    "op2_license_scan": licenses.scan_sql(),
    "op8_exact_topk": """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbor_id) AS n FROM d)
    SELECT vec_id, n::INT AS rank, neighbor_id, round(sqrt(d2), 4) AS distance FROM r WHERE n <= 10""",
}
