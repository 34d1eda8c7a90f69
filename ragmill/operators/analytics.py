"""Query-log and library analytics, per user over live rows. Days are arguments; the clock is never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SOURCES = "array<struct<document_id:long,document_name:string,ranked_score:double>>"


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("deleted_at").isNull())


def overview_counts(documents: DataFrame, chunks: DataFrame, log: DataFrame) -> DataFrame:
    """Documents, chunks and queries of each user; chunks has document_id."""
    docs = live(documents)
    d = docs.groupBy("user_id").agg(F.count("*").alias("documents"))
    per_doc = chunks.groupBy("document_id").agg(F.count("*").alias("k"))
    c = docs.join(per_doc, "document_id").groupBy("user_id").agg(F.sum("k").alias("chunks"))
    q = live(log).groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.count("*").alias("queries"))
    out = d.join(c, "user_id", "full_outer").join(q, "user_id", "full_outer")
    return out.select("user_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("documents", "chunks", "queries")])


def avg_confidence(log: DataFrame) -> DataFrame:
    return live(log).groupBy("user_id").agg(F.coalesce(F.round(F.avg("confidence_score"), 4), F.lit(0.0)).alias("avg_confidence"))


def document_usage(log: DataFrame) -> DataFrame:
    """Retrievals, mean ranked score and last time of each document in the logged sources; bad JSON is skipped."""
    s = live(log).select("user_id", "created_at", "id", F.explode(F.from_json("sources_json", SOURCES)).alias("s"))
    s = s.where(F.col("s.document_id").isNotNull())
    return s.groupBy("user_id", F.col("s.document_id").alias("document_id")).agg(
        F.max_by("s.document_name", F.struct("created_at", "id")).alias("document_name"),
        F.count("*").alias("retrievals"),
        (F.round(F.avg(F.round(F.coalesce("s.ranked_score", F.lit(0.0)) * 10_000).cast("long"))) / 10_000).alias("avg_similarity"),
        F.max("created_at").alias("last_accessed"),
    )


def source_rows(log: DataFrame, documents: DataFrame) -> DataFrame:
    """A row for each logged source whose document still exists and is live: id, user_id, document_id, filename, ranked_score."""
    s = live(log).select("id", "user_id", F.explode(F.from_json("sources_json", SOURCES)).alias("s")).select("id", "user_id", "s.document_id", "s.ranked_score")
    return s.join(live(documents).select("document_id", "filename"), "document_id").select("id", "user_id", "document_id", "filename", "ranked_score")


def most_queried_document(usage: DataFrame) -> DataFrame:
    """The document with most retrievals of each user; ties: the least id."""
    return usage.groupBy("user_id").agg(F.min_by("document_id", F.struct(-F.col("retrievals"), F.col("document_id"))).alias("document_id"), F.max("retrievals").alias("retrievals"))


def queries_per_day(log: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Zero-filled counts of the last days up to today for each user with a live row."""
    counts = live(log).groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    span = F.explode(F.sequence(F.date_sub(F.to_date(F.lit(today)), days - 1), F.to_date(F.lit(today))))
    grid = counts.select("user_id").distinct().select("user_id", span.alias("day"))
    return grid.join(counts, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("queries"))


def top_queries(log: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent non-empty questions of each user; ties: earliest seen, then text."""
    q = live(log).select("user_id", F.trim("question").alias("question"), "created_at").where(F.col("question") != "")
    n = q.groupBy("user_id", "question").agg(F.count("*").alias("count"), F.min("created_at").alias("_first"))
    w = Window.partitionBy("user_id").orderBy(F.col("count").desc(), "_first", "question")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("user_id", "question", "count", F.col("rank").cast("long").alias("rank"))


def coverage_gaps(chunks: DataFrame, threshold: int = 40) -> DataFrame:
    """Documents of which more than threshold percent of the chunks were never retrieved; chunks has retrieved_count."""
    g = chunks.groupBy("document_id").agg(F.count("*").alias("total_chunks"), F.sum(F.when(F.col("retrieved_count") == 0, 1).otherwise(0)).alias("unretrieved"))
    pct = F.bround(F.col("unretrieved") / F.col("total_chunks") * 100).cast("long")
    return g.withColumn("pct", pct).where(F.col("pct") > threshold)


def coverage_heatmap(chunks: DataFrame) -> DataFrame:
    """Retrieved count of each chunk as a share of its document's maximum (1 at least)."""
    top = F.max("retrieved_count").over(Window.partitionBy("document_id"))
    return chunks.select("document_id", "chunk_index", "retrieved_count", F.round(F.col("retrieved_count") / F.greatest(top, F.lit(1)), 6).alias("intensity"))


def request_metrics(requests: DataFrame, window: str = "1 hour") -> DataFrame:
    """Counts, latency buckets and server errors by window, method, endpoint and status; columns ts, method, endpoint (the
    route's template), status, latency."""
    lat = F.col("latency")
    return requests.groupBy(F.window("ts", window)["start"].alias("window_start"), "method", "endpoint", "status").agg(
        F.count("*").alias("requests"),
        F.sum(F.when(lat <= 50, 1).otherwise(0)).alias("le_50"),
        F.sum(F.when(lat <= 100, 1).otherwise(0)).alias("le_100"),
        F.sum(F.when(lat <= 250, 1).otherwise(0)).alias("le_250"),
        F.sum(F.when(F.col("status") >= 500, 1).otherwise(0)).alias("errors"),
    )


def log_correlate(lines: DataFrame) -> DataFrame:
    """Messages of each request in time order; columns request_id, ts, message."""
    return lines.groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "message"))), lambda x: x["message"]), ">").alias("messages"), F.count("*").alias("lines"))
