"""Streams give what their batch forms give."""

import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from ragmill.operators import answers, chunking, library
from ragmill.streaming import ordered, streams


def run(query_df, spark, name, mode, clock=False):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    finish(q) if clock else q.awaitTermination(120)
    return spark.table(name)


def finish(q):
    """A stream with timeouts by the clock runs batches without data for ever, so stop it at the first of them."""
    for _ in range(1_000):
        if not q.isActive:
            break
        if any(p["numInputRows"] == 0 for p in q.recentProgress):
            q.stop()
            break
        time.sleep(0.1)
    if q.exception():
        raise q.exception()


def source(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_request_metrics(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([(t + dt.timedelta(minutes=10 * i), "GET", "q", 500 if i % 3 == 0 else 200) for i in range(20)], "ts timestamp, method string, endpoint string, status int")
    got = run(streams.stream_request_metrics(source(spark, d, tmp_path / "in")), spark, "m", "complete")
    assert got.agg(F.sum("requests"), F.sum("errors")).first() == (20, 7)


def test_answers(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, "token", "a"), (1, 1, "token", "b"), (1, 2, "done", ""), (2, 0, "token", "x")], "query_id long, seq long, kind string, text string")
    got = run(streams.stream_answers(source(spark, d, tmp_path / "in")), spark, "a", "append", clock=True).collect()
    batch = answers.answer_assembly(d).where("complete = 1").collect()
    assert [(r["query_id"], r["answer"]) for r in got] == [(r["query_id"], r["answer"]) for r in batch] == [(1, "ab")]


def test_usage_merges_into_stored(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([(t, 1), (t + dt.timedelta(hours=1), 1), (t, 2)], "ts timestamp, chunk_id long")
    streams.stream_usage_batches(source(spark, d, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    stored = spark.createDataFrame([(1, 5, t), (3, 7, t)], "id long, retrieved_count long, last_at timestamp")
    got = streams.usage_counts(stored, spark.read.parquet(str(tmp_path / "out"))).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 7, t + dt.timedelta(hours=1)), (2, 1, t), (3, 7, t)]


def test_ingest(spark, tmp_path):
    d = spark.createDataFrame([(1, "x" * 1000), (2, "short")], "document_id long, text string")
    q = streams.stream_ingest(source(spark, d, tmp_path / "in"), lambda b: chunking.chunk_text(b, ["document_id"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == chunking.chunk_text(d, ["document_id"]).count()


def test_sse(spark):
    d = spark.createDataFrame([('event: token\ndata: "a"',), ("event: odd\ndata: 1",), ("event: done",)], "frame string")
    assert [tuple(r) for r in streams.sse_parse(d).collect()] == [("token", '"a"')]


def batches(spark, df, path, order):
    """df as a source of one micro-batch for each list of ids."""
    for n, ids in enumerate(order):
        df.where(F.col("id").isin(ids)).coalesce(1).write.parquet(str(path / f"b{n}"))
        for f in (path / f"b{n}").glob("*.parquet"):
            f.rename(path / f"{n}.parquet")
            os.utime(path / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path / "*.parquet"))


def shuffled(spark, tmp_path, rows, schema):
    """Events out of order over three micro-batches, some of them twice, and a last one that moves the watermark on."""
    d = spark.createDataFrame(rows, schema)
    ids = [r[1] for r in rows]
    random.Random(2).shuffle(ids)
    order = [ids[::3], ids[1::3] + ids[:4], ids[2::3] + ids[3:9]]
    end = spark.createDataFrame([(*rows[0][:1], 10**6, dt.datetime(2024, 2, 1), *rows[0][3:])], schema)
    (tmp_path / "in").mkdir()
    return d, batches(spark, d.unionByName(end), tmp_path / "in", [*order, [10**6]])


def test_progress_changes_in_any_order(spark, tmp_path):
    rnd, t = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(k, k * 100 + i, t + dt.timedelta(seconds=rnd.randrange(400)), rnd.choice(["10", "20", "30", "done"] if i % 9 == 0 else ["10", "20"])) for k in range(6) for i in range(25)]
    d, s = shuffled(spark, tmp_path, rows, "key long, id long, ts timestamp, state string")
    got = run(ordered.stream_progress_changes(s), spark, "p", "append").where("id < 1000000").collect()
    assert sorted((r["id"], r["state"]) for r in got) == sorted((r["id"], r["state"]) for r in library.progress_changes(d).collect())


def test_rate_limit_in_any_order(spark, tmp_path):
    rnd, t = random.Random(4), dt.datetime(2024, 1, 1)
    rows = [(rnd.choice(["user:1", "user:2", "ip:a"]), i, t + dt.timedelta(seconds=rnd.randrange(500)), rnd.choice(["query", "upload", "free"])) for i in range(120)]
    d, s = shuffled(spark, tmp_path, rows, "key string, id long, ts timestamp, action string")
    limits = {"query": (3, "minute"), "upload": (5, "hour")}
    got = run(ordered.stream_rate_limit_audit(s, limits), spark, "r", "append").where("id < 1000000").collect()
    assert sorted((r["id"], r["nth"], r["limited"]) for r in got) == sorted((r["id"], r["nth"], r["limited"]) for r in library.rate_limit_audit(d, limits).collect())
    assert {r["limited"] for r in got} == {True, False}


def test_limit_key(spark):
    d = spark.createDataFrame([(1, "a"), (None, "b")], "user_id long, address string")
    assert [r[0] for r in d.select(ordered.limit_key(F.col("user_id"), F.col("address"))).collect()] == ["user:1", "ip:b"]


def test_tables_replace_a_document_that_comes_again(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, "x" * 1000), (2, 2, "kept"), (3, 1, "short now"), (4, 4, "")], "id long, document_id long, text string")
    (tmp_path / "in").mkdir()

    def tables(batch):
        return {"documents": batch.select("document_id", F.length("text").alias("chars")), "chunks": chunking.chunk_text(batch, ["document_id"])}

    def once():
        streams.stream_tables(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in" / "*.parquet")), tables, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)

    batches(spark, d, tmp_path / "in", [[1, 2]])
    once()
    (tmp_path / "later").mkdir()
    batches(spark, d, tmp_path / "later", [[3, 4]])
    (tmp_path / "later" / "0.parquet").rename(tmp_path / "in" / "1.parquet")
    once()  # a restart
    got = streams.newest_tables(spark, str(tmp_path / "out"), ["chunks"])
    assert sorted(tuple(r) for r in got["documents"].collect()) == [(1, 9), (2, 4), (4, 0)]
    assert sorted((r["document_id"], r["content"]) for r in got["chunks"].collect()) == [(1, "short now"), (2, "kept")]


def test_answer_log_of_a_stream(spark, tmp_path):
    frames = spark.createDataFrame([(1, 1, 0, "token", "alpha beta"), (1, 1, 1, "token", " gamma."), (2, 2, 0, "token", "open"), (3, 1, 2, "done", ""), (4, 3, 0, "token", "late"), (5, 3, 1, "done", "")], "id long, query_id long, seq long, kind string, text string")
    q = spark.createDataFrame([(1, "a?"), (2, "b?"), (3, "c?")], "query_id long, question string")
    r = spark.createDataFrame([(1, 1, 10, 100, "doc", "alpha beta gamma", 0.9, 0.8, 0.5)], "query_id long, rank long, id long, document_id long, document_name string, content string, ranked_score double, similarity_score double, importance_score double")

    def log(answers_df):
        known = answers_df.join(q, "query_id")
        return answers.answer_log(known.select("query_id", "question"), r, known.select("query_id", "answer"), "rag")

    (tmp_path / "in").mkdir()
    for n, ids in enumerate([[1, 2], [3, 4], [5]]):
        (tmp_path / f"s{n}").mkdir()
        batches(spark, frames, tmp_path / f"s{n}", [ids])
        (tmp_path / f"s{n}" / "0.parquet").rename(tmp_path / "in" / f"{n}.parquet")
        source_df = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in" / "*.parquet"))
        finish(streams.stream_answer_log(source_df, log, str(tmp_path / "out"), str(tmp_path / "ck")))  # three starts
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = log(answers.answer_assembly(frames).where("complete = 1").select("query_id", "answer"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert {x["query_id"] for x in got.collect()} == {1, 3}
