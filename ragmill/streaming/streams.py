"""Structured Streaming forms of the batch operators. Watermarks are arguments; rows later than that are dropped by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CACHE_SECONDS = 300


def stream_request_metrics(requests: DataFrame, watermark: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Tumbling counts by method, endpoint and status; columns ts, method, endpoint, status."""
    w = requests.withWatermark("ts", watermark).groupBy(F.window("ts", window), "method", "endpoint", "status")
    return w.agg(F.count("*").alias("requests"), F.sum(F.when(F.col("status") >= 500, 1).otherwise(0)).alias("errors")).select(F.col("window.start").alias("window_start"), "method", "endpoint", "status", "requests", "errors")


def stream_usage(sources: DataFrame, watermark: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """Retrieval counts of each user and chunk by window; columns ts, user_id, chunk_id."""
    return sources.withWatermark("ts", watermark).groupBy(F.window("ts", window), "user_id", "chunk_id").agg(F.count("*").alias("retrievals")).select(F.col("window.start").alias("window_start"), "user_id", "chunk_id", "retrievals")


def stream_usage_batches(sources: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's retrievals of each chunk (id, retrieved_count, last_at) under the batch's id, so a repeated
    batch replaces itself; columns ts, chunk_id."""

    def counts(batch: DataFrame) -> DataFrame:
        return batch.groupBy(F.col("chunk_id").alias("id")).agg(F.count("*").alias("retrieved_count"), F.max("ts").alias("last_at"))

    return stream_ingest(sources, counts, path, checkpoint)


def usage_counts(stored: DataFrame, batches: DataFrame) -> DataFrame:
    """Stored counts (id, retrieved_count, last_at) with those of all written batches merged in."""
    cols = ["id", "retrieved_count", "last_at"]
    return stored.select(*cols).unionByName(batches.select(*cols)).groupBy("id").agg(F.sum("retrieved_count").alias("retrieved_count"), F.max("last_at").alias("last_at"))


def stream_rate_counts(events: DataFrame, window: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Events of each key and action by window, to compare with the limit; columns ts, key, action."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "key", "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "key", "action", "n")


def stream_ingest(source: DataFrame, ingest: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a batch ingest on each micro-batch; a batch is written under its id, so a repeated batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        ingest(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return source.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_tables(source: DataFrame, ingest: Callable[[DataFrame], dict[str, DataFrame]], path: str, checkpoint: str) -> StreamingQuery:
    """Run an ingest that gives several tables on each micro-batch. One of them is `documents`; all have document_id. A table
    is written under its batch's number (a repeated batch replaces itself) and `documents` last, as it makes the batch count:
    see newest_tables."""

    def write(batch: DataFrame, epoch: int) -> None:
        tables = ingest(batch)
        for name in sorted(tables, key=lambda n: n == "documents"):
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={epoch}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of stream_tables with each document as its last batch left it: rows of earlier batches are gone from every
    table, also where the last batch gave the document no rows."""
    read = lambda n: spark.read.option("basePath", f"{path}/{n}").parquet(f"{path}/{n}")
    last = read("documents").groupBy("document_id").agg(F.max("batch").alias("batch"))
    return {n: read(n).join(last, ["document_id", "batch"], "left_semi").drop("batch") for n in ["documents", *names]}


def stream_answer_log(frames: DataFrame, log: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Assemble answers from frames and write a history row for each that is finished, by log(answers), say answers.answer_log
    of stored questions and results. Rows lie under their batch's number, so a repeated batch replaces itself; an unfinished
    answer has no row."""
    return stream_ingest(stream_answers(frames), log, path, checkpoint, "append")


def stream_answers(frames: DataFrame) -> DataFrame:
    """One row (query_id, answer) once a query's `done` frame has come; columns query_id, seq, kind, text. State is the
    pieces of unfinished answers, dropped after an hour without frames."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seqs, texts, done = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], False)
        for b in batches:
            t = b[b["kind"] == "token"]
            seqs += t["seq"].tolist()
            texts += t["text"].tolist()
            done = done or bool((b["kind"] == "done").any())
        if done:
            state.remove()
            yield pd.DataFrame({"query_id": [key[0]], "answer": ["".join(x for _, x in sorted(zip(seqs, texts, strict=True)))]})
        else:
            state.update((seqs, texts, done))
            state.setTimeoutDuration(3_600_000)

    return frames.groupBy("query_id").applyInPandasWithState(fold, "query_id long, answer string", "seqs array<long>, texts array<string>, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sse_parse(lines: DataFrame) -> DataFrame:
    """Frames "event: X\\ndata: JSON" of column frame as rows event, data; incomplete and unknown ones are dropped."""
    event = F.regexp_extract("frame", r"(?m)^event: *(\S+)", 1)
    data = F.regexp_extract("frame", r"(?m)^data: *(.*)$", 1)
    known = ["sources", "token", "followups", "hallucination", "done"]
    rest = [F.col(c) for c in lines.columns if c != "frame"]
    return lines.select(*rest, event.alias("event"), data.alias("data")).where(F.col("event").isin(known) & (F.col("data") != ""))


def replay(seconds: int = CACHE_SECONDS):
    """Hit flags over Arrow batches sorted by user, stretch and time: an entry is set on a miss only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = None, {}
        for b in batches:
            hits = []
            for user, stretch, at, key in zip(*(b.column(c).to_pylist() for c in ("user_id", "stretch", "at", "cache_key")), strict=True):
                if (user, stretch) != now:
                    now, made = (user, stretch), {}
                hit = key is not None and key in made and at - made[key] <= seconds * 1_000_000
                if key is not None and not hit:
                    made[key] = at
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(hits, pa.bool_())], names=["id", "hit"])

    return work


def cache_replay(requests: DataFrame, seconds: int = CACHE_SECONDS) -> DataFrame:
    """Which requests an answer cache would serve: id, hit. An entry lives from the miss that made it, hits do not extend
    it, and a document change of the user (a row without cache_key) drops all. Columns id, user_id, ts, cache_key.

    Rows of a user are cut at changes and at pauses longer than an entry lives, where the cache is empty anyway, so a
    group is one busy stretch of one user and not all that the user ever asked."""
    from pyspark.sql import Window

    from ragmill.session import ship

    ship(requests.sparkSession)
    requests = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) > seconds * 1_000_000
    cut = F.sum(F.when(F.col("cache_key").isNull() | F.coalesce(gap, F.lit(True)), 1).otherwise(0)).over(w)
    r = requests.select("id", "user_id", "cache_key", F.unix_micros("ts").alias("at"), cut.alias("stretch"))
    by = ["user_id", "stretch"]
    return r.repartition(*by).sortWithinPartitions(*by, "at", "id").mapInArrow(replay(seconds), "id long, hit boolean")
