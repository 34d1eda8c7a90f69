"""Queries whose operators also run as streams, in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.operators.answers import answer_assembly as assemble
from ragmill.plans.registry import query
from ragmill.sources import io
from ragmill.sources.views import table
from ragmill.streaming import streams


@query("cache_replay", """WITH RECURSIVE e AS (SELECT event_id AS id, user_id, ts, CASE WHEN event_type = 'signup' THEN NULL ELSE event_type END AS k FROM events),
  s AS (SELECT *, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, id) AS part FROM e),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id, part, k ORDER BY ts, id) AS o FROM s WHERE k IS NOT NULL),
  r AS (SELECT id, user_id, part, k, o, ts AS made, false AS hit FROM n WHERE o = 1
    UNION ALL SELECT n.id, n.user_id, n.part, n.k, n.o, CASE WHEN n.ts <= r.made + INTERVAL 3600 SECOND THEN r.made ELSE n.ts END, n.ts <= r.made + INTERVAL 3600 SECOND FROM r JOIN n ON n.user_id = r.user_id AND n.part = r.part AND n.k = r.k AND n.o = r.o + 1)
  SELECT id, hit FROM r UNION ALL SELECT id, false FROM e WHERE k IS NULL""")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests keyed by event type, an hour's cache; a signup stands for a document change."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts", F.when(F.col("event_type") != "signup", F.col("event_type")).alias("cache_key"))
    return streams.cache_replay(e, 3_600)


@query("answer_assembly", "SELECT conv_id AS query_id, string_agg(text, '' ORDER BY turn) AS answer, CAST(max(CASE WHEN turn >= 3 THEN 1 ELSE 0 END) AS INTEGER) AS complete FROM conversations GROUP BY 1")
def answer_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    tokens = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), F.lit("token").alias("kind"), "text")
    done = c.where("turn >= 3").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), F.lit("done").alias("kind"), F.lit("").alias("text"))
    return assemble(tokens.unionByName(done))


@query("sse_parse", "SELECT conv_id, turn, role AS event, '\"' || turn || '\"' AS data FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'token' ELSE 'done' END AS role FROM conversations) AS c")
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("turn") % 2 == 0, "token").otherwise("done")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("event: "), kind, F.lit('\ndata: "'), F.col("turn").cast("string"), F.lit('"')).alias("frame"))
    return streams.sse_parse(c)


@query("upload_gate", """SELECT page_id, CASE WHEN ft NOT IN ('pdf', 'docx', 'xlsx', 'pptx', 'txt', 'md', 'csv') THEN '415' WHEN ft IN ('txt', 'md') THEN 'ok' ELSE '422' END AS status
  FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' WHEN 2 THEN 'exe' ELSE 'docx' END AS ft FROM pages) AS p""")
def upload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("page_id") % 4
    kind = F.when(m == 0, "txt").when(m == 1, "pdf").when(m == 2, "exe").otherwise("docx")
    return io.upload_gate(table(spark, sf_dir, "pages").select("page_id", kind.alias("file_type"), F.col("html").cast("binary").alias("content"))).select("page_id", "status")


@query("json_vectors", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def json_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.to_json("embedding").alias("j"))
    v = e.select("vec_id", io.json_vectors(F.col("j")).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
