"""Queries over the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.operators import analytics as an
from ragmill.plans.registry import query
from ragmill.plans.text_queries import CHUNKS_SQL, chunks
from ragmill.sources.views import DOCS_SQL, LOG_SQL, documents, query_log, table

TODAY = "2024-01-30"


@query("overview_counts", f"""WITH {CHUNKS_SQL}, {LOG_SQL}, d AS (SELECT user_id, count(*) AS documents FROM docs WHERE deleted_at IS NULL GROUP BY 1),
  c AS (SELECT user_id, count(*) AS chunks FROM chunks WHERE deleted_at IS NULL GROUP BY 1), q AS (SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS queries FROM qlog WHERE deleted_at IS NULL GROUP BY 1),
  u AS (SELECT user_id FROM d UNION SELECT user_id FROM q)
  SELECT u.user_id, coalesce(documents, 0) AS documents, coalesce(chunks, 0) AS chunks, coalesce(queries, 0) AS queries FROM u LEFT JOIN d ON d.user_id = u.user_id LEFT JOIN c ON c.user_id = u.user_id LEFT JOIN q ON q.user_id = u.user_id""")
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.overview_counts(documents(spark, sf_dir), chunks(spark, sf_dir), query_log(spark, sf_dir))


@query("avg_confidence", f"WITH {LOG_SQL} SELECT user_id, coalesce(round(avg(confidence_score), 4), 0) AS avg_confidence FROM qlog WHERE deleted_at IS NULL GROUP BY 1")
def avg_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.avg_confidence(query_log(spark, sf_dir))


USAGE_SQL = LOG_SQL + ", usage AS (SELECT user_id, k AS document_id, 'doc_' || k || '.txt' AS document_name, count(*) AS retrievals, round(avg(CAST(round(coalesce(round(confidence_score, 4), 0) * 10000) AS BIGINT))) / 10000 AS avg_similarity, max(created_at) AS last_accessed FROM qlog WHERE deleted_at IS NULL AND k IS NOT NULL GROUP BY 1, 2, 3)"


@query("document_usage", f"WITH {USAGE_SQL} SELECT * FROM usage")
def document_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.document_usage(query_log(spark, sf_dir))


@query("most_queried_document", f"WITH {USAGE_SQL} SELECT user_id, document_id, retrievals FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY retrievals DESC, document_id) AS o FROM usage) AS q WHERE o = 1")
def most_queried_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.most_queried_document(an.document_usage(query_log(spark, sf_dir)))


@query("queries_per_day", f"""WITH {LOG_SQL}, u AS (SELECT DISTINCT user_id FROM qlog WHERE deleted_at IS NULL), g AS (SELECT user_id, CAST(DATE '{TODAY}' - CAST(i AS INTEGER) AS DATE) AS day FROM u, range(0, 7) AS r(i)),
  c AS (SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS n FROM qlog WHERE deleted_at IS NULL GROUP BY 1, 2)
  SELECT g.user_id, CAST(g.day AS VARCHAR) AS day, coalesce(n, 0) AS queries FROM g LEFT JOIN c ON c.user_id = g.user_id AND c.day = g.day""")
def queries_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.queries_per_day(query_log(spark, sf_dir), TODAY).withColumn("day", F.col("day").cast("string"))


@query("top_queries", f"""WITH {LOG_SQL}, n AS (SELECT user_id, trim(question) AS question, count(*) AS "count", min(created_at) AS f FROM qlog WHERE deleted_at IS NULL AND trim(question) <> '' GROUP BY 1, 2)
  SELECT user_id, question, "count", rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "count" DESC, f, question) AS rank FROM n) AS q WHERE rank <= 10""")
def top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.top_queries(query_log(spark, sf_dir))


RETRIEVED_SQL = CHUNKS_SQL + ", " + LOG_SQL + ", hits AS (SELECT k AS document_id, count(*) AS n FROM qlog WHERE k IS NOT NULL GROUP BY 1), rc AS (SELECT c.document_id, c.chunk_index, CASE WHEN (c.chunk_index + c.document_id) % 3 = 0 THEN coalesce(n, 0) ELSE 0 END AS retrieved_count FROM chunks AS c LEFT JOIN hits AS h ON h.document_id = c.document_id)"


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a retrieval count: that of the logged document for every third chunk."""
    hits = query_log(spark, sf_dir).select(F.explode(F.from_json("sources_json", an.SOURCES)).alias("s")).groupBy(F.col("s.document_id").alias("document_id")).agg(F.count("*").alias("n"))
    c = chunks(spark, sf_dir).join(hits, "document_id", "left")
    n = F.when((F.col("chunk_index") + F.col("document_id")) % 3 == 0, F.coalesce("n", F.lit(0))).otherwise(0)
    return c.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), n.alias("retrieved_count"))


@query("coverage_gaps", f"""WITH {RETRIEVED_SQL}, g AS (SELECT document_id, count(*) AS total_chunks, CAST(sum(CASE WHEN retrieved_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unretrieved FROM rc GROUP BY 1)
  SELECT *, CAST(round_even(unretrieved / total_chunks * 100, 0) AS BIGINT) AS pct FROM g WHERE round_even(unretrieved / total_chunks * 100, 0) > 40""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.coverage_gaps(retrieved(spark, sf_dir))


@query("coverage_heatmap", f"WITH {RETRIEVED_SQL} SELECT document_id, chunk_index, retrieved_count, round(retrieved_count / greatest(max(retrieved_count) OVER (PARTITION BY document_id), 1), 6) AS intensity FROM rc")
def coverage_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.coverage_heatmap(retrieved(spark, sf_dir))


@query("request_metrics", """SELECT date_trunc('hour', ts) AS window_start, CASE WHEN user_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, count(*) AS requests,
  CAST(sum(CASE WHEN value <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS le_50, CAST(sum(CASE WHEN value <= 100 THEN 1 ELSE 0 END) AS BIGINT) AS le_100, CAST(sum(CASE WHEN value <= 250 THEN 1 ELSE 0 END) AS BIGINT) AS le_250,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY 1, 2, 3, 4""")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", F.when(F.col("user_id") % 3 == 0, "POST").otherwise("GET").alias("method"), F.col("event_type").alias("endpoint"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency"))
    return an.request_metrics(e)


@query("source_explode_join", f"WITH {LOG_SQL}, {DOCS_SQL} SELECT l.id, l.user_id, document_id, filename, round(confidence_score, 4) AS ranked_score FROM qlog AS l JOIN docs AS d ON d.document_id = l.k WHERE l.deleted_at IS NULL AND d.deleted_at IS NULL")
def source_explode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.source_rows(query_log(spark, sf_dir), documents(spark, sf_dir))


@query("log_correlate", "SELECT user_id AS request_id, string_agg(event_type, '>' ORDER BY ts, event_type) AS messages, count(*) AS lines FROM events GROUP BY 1")
def log_correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), "ts", F.col("event_type").alias("message"))
    return an.log_correlate(e)


@query("usage_sort", f"WITH {USAGE_SQL} SELECT user_id, document_id, retrievals, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(avg_similarity, 0) DESC, document_id) AS position FROM usage")
def usage_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    u = an.document_usage(query_log(spark, sf_dir))
    w = Window.partitionBy("user_id").orderBy(F.coalesce("avg_similarity", F.lit(0.0)).desc(), "document_id")
    return u.select("user_id", "document_id", "retrievals", F.row_number().over(w).cast("long").alias("position"))
