"""The test tables seen as the library's model: documents of tenants, chunks, questions and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TIME = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    created = F.to_timestamp(F.lit(BASE_TIME)) + F.make_dt_interval(secs=F.col("doc_id"))
    return d.select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("user_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.col("lang"),
        F.col("text"),
        created.alias("created_at"),
        F.when(F.col("doc_id") % 17 == 0, created + F.expr("INTERVAL 1 DAY")).alias("deleted_at"),
        F.when(F.col("n_chars") < 60, "failed").otherwise("done").alias("processing_status"),
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    score = F.col("value") / 500
    source = F.struct(k.alias("document_id"), F.concat(F.lit("doc_"), k.cast("string"), F.lit(".txt")).alias("document_name"), F.round(score, 4).alias("ranked_score"))
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("mode"),
        F.concat(F.col("event_type"), F.lit(" "), F.coalesce(k.cast("string"), F.lit(""))).alias("question"),
        score.alias("confidence_score"),
        F.to_json(F.array(source)).alias("sources_json"),
        F.when(F.col("event_id") % 19 == 0, F.col("ts")).alias("deleted_at"),
        (F.col("event_id") % 7 == 0).alias("bookmarked"),
    )


#: The same views for DuckDB.
DOCS_SQL = """docs AS (SELECT doc_id AS document_id, source AS user_id, 'doc_' || doc_id || '.txt' AS filename, lang, text,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS created_at,
    CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' + to_seconds(doc_id) END AS deleted_at,
    CASE WHEN n_chars < 60 THEN 'failed' ELSE 'done' END AS processing_status FROM documents)"""
LOG_SQL = """qlog AS (SELECT event_id AS id, user_id, ts AS created_at, event_type AS mode, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    event_type || ' ' || coalesce(CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR), '') AS question, value / 500 AS confidence_score,
    CASE WHEN event_id % 19 = 0 THEN ts END AS deleted_at, event_id % 7 = 0 AS bookmarked FROM events)"""
