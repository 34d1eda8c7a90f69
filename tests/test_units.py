"""Small exact cases of the rules."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragmill.functions import text as tx
from ragmill.operators import answers, bm25, chunking, importance, ingest, library, retrieval, vectors
from ragmill.sources import io
from ragmill.streaming import streams


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_chunk_text_lengths(spark):
    text = "".join(chr(97 + i % 26) for i in range(2000))
    d = spark.createDataFrame([(1, text), (2, "hello world"), (3, "  "), (4, None)], "document_id long, text string")
    got = chunking.chunk_text(d, ["document_id"]).orderBy("document_id", "chunk_index").collect()
    assert [len(r["content"]) for r in got if r["document_id"] == 1] == [800, 800, 700]
    assert got[0]["content"][-150:] == got[1]["content"][:150]
    assert [r["content"] for r in got if r["document_id"] == 2] == ["hello world"]
    assert not [r for r in got if r["document_id"] > 2]
    with pytest.raises(ValueError):
        chunking.chunk_text(d, ["document_id"], size=10, overlap=10)


def test_sentences(spark):
    assert len(one(spark, tx.split_sentences, "Mr. Smith said hello. He then left the building.")) == 2
    assert one(spark, tx.split_sentences, "  ") == []
    assert one(spark, tx.split_sentences, "See Fig.   2 now. Yes! No?  Ok") == ["See Fig. 2 now.", "Yes!", "No?  Ok".replace("  Ok", ""), "Ok"]


def packed_by_hand(lengths, limit, overlap):
    out, i, n = [], 0, len(lengths)
    while i < n:
        begin, total = i, lengths[i]
        i += 1
        while i < n and total + 1 + lengths[i] <= limit:
            total += 1 + lengths[i]
            i += 1
        out.append((begin, i))
        if i < n:
            i = max(begin + 1, i - overlap)
    return out


def test_packed_ranges(spark):
    rnd = random.Random(5)
    cases = [[5, 5, 5, 5], [50], [], [1] * 40, [30, 1, 1, 30], *[[rnd.randrange(1, 30) for _ in range(rnd.randrange(60))] for _ in range(30)]]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x array<int>")
    for limit, overlap in ((11, 1), (11, 2), (40, 2), (40, 0)):
        got = d.select("i", chunking.packed_ranges(F.col("x"), limit, overlap).alias("r")).collect()
        assert {r["i"]: [tuple(x) for x in r["r"]] for r in got} == {i: packed_by_hand(c, limit, overlap) for i, c in enumerate(cases)}


def test_chunk_semantic_has_no_python(spark):
    d = spark.createDataFrame([(1, "One. Two.")], "document_id long, text string").withColumn("blocks", chunking.line_blocks(F.col("text")))
    plan = chunking.chunk_semantic(d, ["document_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_outline_of_blocks(spark):
    block = "array<struct<text:string,page:int,heading:string,level:int,is_heading:boolean>>"
    blocks = [("Top", 1, " Top ", 0, True), ("body\nSECOND PART\nmore text here, and so on.", 1, None, 0, False), ("x", 2, "Deep", 5, True), ("x", 2, "top", 2, True), ("x", 2, "Mid", 2, True), ("x", 2, "", 2, True)]
    d = spark.createDataFrame([(1, blocks)], f"document_id long, blocks {block}")
    c = spark.createDataFrame([(1, 0, "top second"), (1, 1, "a second part, deep")], "document_id long, chunk_index int, content string")
    got = importance.outline(d, c, blocks="blocks").orderBy("line_no").collect()
    assert [(r["heading"], r["level"], r["chunk_index"]) for r in got] == [("Top", 1, 0), ("SECOND PART", 1, 1), ("Deep", 3, 1), ("Mid", 2, 0)]


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, "group string, id long, content string")


def test_bm25_index_grows_without_rebuild(spark, tmp_path):
    rnd = random.Random(9)
    text = lambda: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(rnd.randrange(12)))
    rows = [(rnd.choice("ab"), i, text()) for i in range(60)] + [("big", 100 + i, "common " + text()) for i in range(40)] + [("one", 500, "alpha alpha"), ("empty", 501, "!")]
    q = spark.createDataFrame([(1, "a", "alpha beta"), (2, "big", "common"), (3, "big", "zzz"), (4, "none", "alpha"), (5, "one", "alpha beta"), (6, "b", "kappa kappa iota")], "query_id long, group string, question string")
    whole = bm25.build(chunks_of(spark, rows), str(tmp_path / "whole"), 2, 4)
    parts = bm25.build(chunks_of(spark, rows[::2]), str(tmp_path / "parts"), 2, 4).merge(chunks_of(spark, rows[1::2]))
    parts = parts.merge(chunks_of(spark, rows[1::2]), batch=1)  # the same batch again
    key = lambda df: sorted(map(tuple, df.select("query_id", "id", F.round("sparse_score", 7), "rank").collect()))
    assert key(retrieval.bm25_search(parts, q, 7)) == key(retrieval.bm25_search(whole, q, 7))
    idf = lambda i: sorted((r["group"], r["term"], round(r["idf"], 9)) for r in i.idf().collect())
    assert idf(parts) == idf(whole)
    one_term = spark.createDataFrame([("a", "alpha")], "group string, term string")
    read = whole.pruned("postings", one_term)
    assert "PartitionFilters: [" in (plan := read._jdf.queryExecution().executedPlan().toString()) and "tb" in plan
    assert read.select("gb", "tb").distinct().count() == 1 < whole.read("postings").select("gb", "tb").distinct().count()


def test_bm25_fill_is_exact(spark):
    """Queries with few or no matches are filled up with the largest other ids, as a scan of all chunks would."""
    rows = [("g", i, "word" if i in (3, 7) else "other text") for i in range(30)]
    q = spark.createDataFrame([(1, "g", "word"), (2, "g", "nothing")], "query_id long, group string, question string")
    got = retrieval.bm25_search(bm25.build(chunks_of(spark, rows)), q, 6).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got] == [7, 3, 29, 28, 27, 26, 29, 28, 27, 26, 25, 24]


@pytest.mark.parametrize("size", [1 << 20, 256])
def test_dense_topk_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(vectors, "BLOCK_BYTES", size)  # 256 bytes: four vectors a block
    rnd = np.random.default_rng(1)
    v = [(["a", "b"][i % 7 == 0], i, rnd.integers(-2, 3, 8).astype(float).tolist()) for i in range(150)] + [("a", 900, []), ("a", 901, None), ("a", 902, [1.0, 2.0])]
    q = [(i, g, e) for g, i, e in v[:20]] + [(500, "a", [0.0] * 8), (501, "zz", [1.0] * 8), (502, "a", None)]
    vs, qs = spark.createDataFrame(v, "group string, id long, embedding array<double>"), spark.createDataFrame(q, "query_id long, group string, embedding array<double>")
    for by_group in (True, False):
        want = []
        for i, g, e in q:
            if e and any(e):
                unit = lambda x: np.array(x) / (np.sqrt(np.dot(x, x)) or 1)
                near = sorted(((-round(float(unit(e) @ unit(x)), 9), -n) for h, n, x in v if x and len(x) == 8 and (h == g or not by_group)))[:5]
                want += [(i, -n, -s, k + 1) for k, (s, n) in enumerate(near)]
        got = [tuple(r) for r in vectors.dense_topk(vs, qs, 5, by_group).select("query_id", "id", "similarity", "rank").collect()]
        assert sorted((a, b, round(c, 7), d) for a, b, c, d in got) == sorted((a, b, round(c, 7), d) for a, b, c, d in want)


def test_inverted_lists_hold_every_row(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((12, 16)) * 3
    v = spark.createDataFrame([(i, (centres[i % 12] + rnd.standard_normal(16) * 0.3).tolist()) for i in range(600)] + [(1000, [0.0] * 16)], "id long, embedding array<double>")
    lists = vectors.inverted_lists(v, 5, sample=200)
    assert lists.vectors.count() == 601 and 1 <= lists.probes < len(lists.centres)
    q = v.where("id % 20 = 0 AND id < 600").select(F.col("id").alias("query_id"), "embedding")
    found = {(r["query_id"], r["id"]) for r in vectors.ann_candidates(lists, q, 5).collect()}
    exact = {(r["query_id"], r["id"]) for r in vectors.dense_topk(v.withColumn("group", F.lit(0)), q.withColumn("group", F.lit(0)), 5).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_cascade_rejects_a_ring(spark):
    t = spark.createDataFrame([(1, 1)], "a long, b long")
    with pytest.raises(ValueError, match="round"):
        library.cascade({"x": t, "y": t}, {}, {"x": [("y", "a", "a")], "y": [("x", "b", "b")]})


def test_cascade_children_of_children(spark):
    f = spark.createDataFrame
    tables = {"users": f([("u",), ("v",)], "user_id string"), "documents": f([(1, "u", "k1"), (2, "v", None)], "document_id long, user_id string, storage_key string"), "chunks": f([(10, 1), (20, 2)], "chunk_id long, document_id long"), "chunk_coverage": f([(10, "v"), (20, "u"), (20, "v")], "chunk_id long, user_id string")}
    stays, counts, files = library.purge_users(tables, tables["users"].where("user_id = 'u'"))
    assert {r["table"]: r["rows"] for r in counts.collect()} == {"users": 1, "documents": 1, "chunks": 1, "chunk_coverage": 2}
    assert [tuple(r) for r in stays["chunk_coverage"].collect()] == [(20, "v")] and [r[0] for r in files.collect()] == ["k1"]


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/library;create=true"
    d = spark.createDataFrame([(i, None if i % 4 == 0 else f"name {i}", None if i % 3 == 0 else i / 2) for i in range(50)] + [(None, "no id", 1.0)], "doc_id long, name string, score double")
    io.write_jdbc(d, url, "DOCS", 2)
    names = [c.upper() for c in d.columns]
    back = io.read_jdbc(spark, url, "DOCS", '"doc_id"', 4)
    assert back.rdd.getNumPartitions() == 4 and [c.upper() for c in back.columns] == names
    assert sorted(map(str, back.collect())) == sorted(map(str, d.collect()))
    io.write_jdbc(d.limit(0), url, "NOTHING", 2)
    assert io.read_jdbc(spark, url, "NOTHING", '"doc_id"', 4).collect() == []


def test_compare_context(spark):
    r = spark.createDataFrame([(1, 0, 1, "a", "a1"), (1, 0, 2, "a", "a2"), (1, 1, 1, "b", "b1"), (1, 2, 1, "a", "again")], "query_id long, position int, rank int, document_name string, content string")
    assert answers.compare_context(r).first()["context"] == "Document: a\n[1] again\n\nDocument: b\n[2] b1"
    assert answers.compare_context(r.where("position < 2")).first()["context"] == "Document: a\n[1] a1\n[2] a2\n\nDocument: b\n[3] b1"



def test_blocks(spark):
    d = spark.createDataFrame([(1, "OVERVIEW\nbody text here\n\nmore")], "document_id long, text string").withColumn("blocks", chunking.line_blocks(F.col("text")))
    first = chunking.chunk_blocks(d, ["document_id"], size=40, overlap=10).orderBy("chunk_index").first()
    assert first["section_heading"] == "OVERVIEW" and first["page_number"] == 1
    packed = chunking.chunk_semantic(d, ["document_id"]).collect()
    assert packed[0]["content"].startswith("OVERVIEW body text")


def test_importance_and_highlights(spark):
    rows = [(1, i, f"Alpha beta gamma number{i}. Delta Epsilon Zeta.") for i in range(12)] + [(2, 0, "only one")]
    s = importance.chunk_importance(spark.createDataFrame(rows, "document_id long, chunk_index int, content string"))
    got = s.collect()
    assert all(0 <= r["importance_score"] <= 1 for r in got)
    assert [r["importance_score"] for r in got if r["document_id"] == 2] == [1.0]
    h = importance.highlights(s).where("document_id = 1").collect()
    assert len(h) == 8 and all(r["text"] == "Delta Epsilon Zeta." for r in h)


def test_embedding():
    import pandas as pd

    v = vectors.embed_array(pd.Series(["hello world hello", "", None]))
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-9 and v[0][402] != 0 and not v[1].any() and not v[2].any()


def test_cosine(spark):
    d = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0, 0.0]


def test_near_duplicates_blocks(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("u", i, base + dt.timedelta(seconds=i), 2, [1.0, 0.01 * (i % 3)]) for i in range(40)] + [("u", 99, base, 2, [0.0, 1.0]), ("v", 100, base, 2, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "user_id string, document_id long, created_at timestamp, dim int, centroid array<double>")
    for block in (8, 512):
        got = {r["document_id"]: r["duplicate_of"] for r in vectors.near_duplicates(d, block=block).collect()}
        assert got == {i: 0 for i in range(1, 40)}


def test_ann_agrees_with_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(0, i, (np.eye(8)[i % 8] + rng.normal(0, 0.02, 8)).tolist()) for i in range(80)]
    v = spark.createDataFrame(rows, "`group` int, id long, embedding array<double>")
    q = v.where("id < 8").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in vectors.dense_topk(v, q, 5, by_group=False).collect()}
    near = {(r["query_id"], r["id"]) for r in vectors.ann_candidates(v, q, 5).collect()}
    assert len(exact) == 40 and len(exact & near) >= 36


def test_json_and_followups(spark):
    assert one(spark, tx.parse_json_questions, 'Sure: ["a?", " b ", ""] ok') == ["a?", "b"]
    assert one(spark, tx.parse_json_questions, "garbage") == []
    ev = one(spark, tx.parse_json_events, 'x [{"date":"2020","event":"E"},{"date":"","event":"no"}] y')
    assert [(e["date"], e["event"], e["chunk_index"]) for e in ev] == [("2020", "E", 0)]
    r = one(spark, tx.split_followups, "answer ===FOLLOWUPS=== [1]")
    assert (r["answer"], r["rest"]) == ("answer", "[1]")
    assert one(spark, tx.split_followups, " none ")["answer"] == " none "
    assert one(spark, tx.citations, "a [1] b [12][x]") == [1, 12]


def test_cache_key(spark):
    d = spark.createDataFrame([("u", "What  is X", "rag"), ("u", " what is x ", "rag"), ("v", "what is x", "rag")], "u string, q string, m string")
    k = [r[0] for r in d.select(tx.cache_key(F.col("u"), F.col("q"), F.col("m"))).collect()]
    assert k[0] == k[1] != k[2]


def test_grounding_and_confidence(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    a = spark.createDataFrame([(1, "Revenue growth reached Boston offices. Martian colonies expanded quickly everywhere."), (2, "x")], "query_id long, answer string")
    r = spark.createDataFrame([(1, 1, 10, "Revenue growth in Boston offices", 0.9, 0.85)], "query_id long, rank long, id long, content string, similarity_score double, ranked_score double")
    g = answers.grounding_check(a, r).orderBy("query_id", "sentence_no").collect()
    assert [x["supported"] for x in g] == [True, False, True] and g[0]["source_id"] == 10
    c = {x["query_id"]: x["confidence"] for x in answers.confidence(q, r, a, answers.grounding_check(a, r)).collect()}
    assert c[2] == 0.0 and 0.6 < c[1] <= 1


def test_rate_limit(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "u", "login", t + dt.timedelta(seconds=i)) for i in range(5)] + [(9, "v", "login", t), (10, "u", "other", t)]
    d = library.rate_limit_audit(spark.createDataFrame(rows, "id long, key string, action string, ts timestamp"), {"login": (3, "minute")})
    assert [r["limited"] for r in d.orderBy("id").collect()] == [False] * 3 + [True] * 2 + [False] * 2


def test_upload_gate(spark):
    rows = [("pdf", b" \n%PDF-1.4"), ("pdf", b"MZ.."), ("txt", b""), ("exe", b"x"), ("docx", b"PK\x03\x04zz"), ("txt", b"a\x00b"), ("txt", "é".encode()), ("md", b"\x80\x81"), ("csv", b"caf\xe9,abcdefghijkl")]
    d = io.upload_gate(spark.createDataFrame([(i, k, bytearray(c)) for i, (k, c) in enumerate(rows)], "i int, file_type string, content binary"))
    assert [r["status"] for r in d.orderBy("i").collect()] == ["ok", "422", "400", "415", "ok", "422", "ok", "422", "ok"]


def test_uploads_and_export(spark, tmp_path):
    (tmp_path / "u1").mkdir()
    (tmp_path / "u1" / "a.TXT").write_text("hello")
    r = io.read_uploads(spark, str(tmp_path)).first()
    assert (r["user_id"], r["file_type"], r["length"]) == ("u1", "txt", 5)
    d = spark.createDataFrame([("u1", 1, None), ("u2", 2, dt.datetime(2024, 1, 1))], "user_id string, document_id long, deleted_at timestamp")
    io.export_user_data(d, d, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "documents")).count() == 1
    assert spark.read.json(str(tmp_path / "out" / "highlights")).select("document_id", "highlights").collect() == [(1, [])]


def test_csv_blocks(spark):
    rows = [(1, 'a,,"b ""x"", y"\n1,2,"p\nq",9\n,,\n3\n'), (2, ""), (3, None), (4, "only,header"), (5, "a\n" + "v" * 200_000)]
    d = spark.createDataFrame(rows, "id int, text string")
    got = [(r["id"], r["row_no"], r["text"]) for r in chunking.csv_blocks(d, ["id"]).orderBy("id", "row_no").collect()]
    assert got == [(1, 0, 'a: 1, Column: 2, b "x", y: p\nq'), (1, 1, "a: 3"), (5, 0, "a: " + "v" * 200_000)]


def test_embedder_is_an_argument(spark):
    d = spark.createDataFrame([("ab",), (None,)], "content string")
    got = vectors.hash_embed(d, embedder=lambda t: t.fillna("").map(lambda x: [float(len(x)), 1.0])).collect()
    assert sorted(r["embedding"] for r in got) == [[0.0, 1.0], [2.0, 1.0]]
    with pytest.raises(Exception, match="embedder gave 1 vectors"):
        vectors.hash_embed(d.coalesce(1), embedder=lambda t: t.head(1).map(lambda x: [1.0])).collect()


def test_duplicates_of_new_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 4))
    made = [(f"u{i % 2}", i, 4, (base[i % 6] + 0.05 * rng.normal(size=4)).tolist()) for i in range(60)] + [("u9", 99, 4, [0.0] * 4), ("u0", 100, 3, [1.0] * 3)]
    d = spark.createDataFrame(made, "user_id string, document_id long, dim int, centroid array<double>").selectExpr("*", "timestamp_seconds(100 - document_id) AS created_at")
    new, stored = d.where("document_id % 5 = 0 OR document_id = 99"), d.where("document_id % 5 <> 0")
    got = {r["document_id"]: r["duplicate_of"] for r in vectors.duplicates_of_new(new, stored, block=3).collect()}
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    want = {}
    for u, i, k, v in made:
        hits = [j for w, j, m, x in made if j % 5 and w == u and m == k and np.any(x) and np.any(v) and cos(v, x) > vectors.NEAR]
        if i % 5 == 0 and hits:
            want[i] = max(hits)  # the largest id is the earliest
    assert got == want and len(want) > 5


@pytest.mark.parametrize("strategy", ["semantic", "character"])
def test_ingest_whole(spark, strategy):
    text = "RESULTS\nThe first sentence is here. Another one follows it.\n\nMethods Used\nSome more text stands here."
    rows = [("u", 1, text), ("u", 2, text), ("v", 3, text), ("u", 4, ""), ("u", 5, None)]
    d = spark.createDataFrame(rows, "user_id string, document_id long, text string").selectExpr("*", "timestamp_seconds(document_id) AS created_at").withColumn("blocks", chunking.line_blocks(F.col("text")))
    docs, chunks = ingest.ingest(d, strategy=strategy)
    got = {r["document_id"]: r for r in docs.collect()}
    assert {i: r["processing_status"] for i, r in got.items()} == {1: "done", 2: "done", 3: "done", 4: "failed", 5: "failed"}
    assert {i: r["duplicate_of"] for i, r in got.items()} == {1: None, 2: 1, 3: None, 4: None, 5: None}
    assert [x["text"] for x in json.loads(got[1]["outline_json"])] == ["RESULTS", "Methods Used"] and got[4]["processing_error"] and got[4]["outline_json"] is None
    assert json.loads(got[1]["highlights_json"])[0]["score"] == 1.0 and got[1]["summary_input"] and got[1]["chunks"] == 1
    assert sorted(chunks.select("document_id").collect()) == [(1,), (2,), (3,)]
    stored = spark.createDataFrame([("v", 77)], "user_id string, document_id long").selectExpr("*", "timestamp_seconds(0) AS created_at")
    old = stored.crossJoin(vectors.doc_centroid(chunks.where("document_id = 1")).drop("document_id"))
    assert ingest.ingest(d, old, strategy)[0].where("document_id = 3").first()["duplicate_of"] == 77


def test_answer_log(spark):
    q = spark.createDataFrame([(1, "a?"), (2, "b?")], "query_id long, question string")
    r = spark.createDataFrame([(1, 2, 20, 5, "y.txt", "second", 0.5, 0.3, 0.1), (1, 1, 10, 4, "x.txt", "first", 1.2, 0.9, 0.25)], "query_id long, rank long, id long, document_id long, document_name string, content string, ranked_score double, similarity_score double, importance_score double")
    got = {x["query_id"]: x for x in answers.answer_log(q, r, answers.offline_answer(q, r), "rag").collect()}
    assert [(s["chunk_id"], s["ranked_score"]) for s in json.loads(got[1]["sources_json"])] == [(10, 1.0), (20, 0.5)]
    assert got[2]["sources_json"] is None and got[2]["confidence_score"] == 0.0 and got[2]["answer"] == answers.NOTHING


def test_cache_replay_anchored(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "u", 0, "k"), (2, "u", 200, "k"), (3, "u", 301, "k"), (4, "u", 310, None), (5, "u", 311, "k"), (6, "v", 0, "k")]
    d = spark.createDataFrame([(i, u, t + dt.timedelta(seconds=s), k) for i, u, s, k in rows], "id long, user_id string, ts timestamp, cache_key string")
    assert {r["id"]: r["hit"] for r in streams.cache_replay(d).collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_compare_answer(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    r = spark.createDataFrame([(1, 2, 1, "b.txt", " short "), (1, 0, 1, "a.txt", "word " * 100), (1, 0, 2, "a.txt", "second")], "query_id long, position int, rank int, document_name string, content string")
    got = {x["query_id"]: x["answer"] for x in answers.offline_compare_answer(q, r).collect()}
    cut = ("word " * 60).rstrip().rsplit(" ", 1)[0] if ("word " * 60)[:300].endswith("d") else ("word " * 60)[:300].rsplit(" ", 1)[0]
    assert got[1] == f"{answers.COMPARE_TOP}\n\n**a.txt** [1]: {cut}…\n\n**b.txt** [2]: short"
    assert got[2] == answers.COMPARE_NOTHING


def test_answer_blocks_whole_texts(spark):
    """Blocks of hard texts, line by line."""
    texts = ["plain\nlines\n\n- a\n- b\n# one\n## two\n### three\ntail ", "", "  - x  \n\n\n-y\n- ", "a\n\nb"]
    want = []
    for i, t in enumerate(texts):
        blocks, last = [], None
        for line in t.split("\n"):
            line = line.strip()
            head = line.startswith(("## ", "### "))
            kind = "blank" if not line else "heading" if head else "list" if line.startswith("- ") else "paragraph"
            text = line.split(" ", 1)[1] if head else line[2:] if kind == "list" else line
            if kind == last and kind not in ("heading", "blank"):
                blocks[-1][1].append(text)
            elif kind != "blank":
                blocks.append((kind, [text]))
            last = kind
        want += [(i, n + 1, k, " ".join(x)) for n, (k, x) in enumerate(blocks)]
    got = answers.answer_blocks(spark.createDataFrame(list(enumerate(texts)), "query_id long, answer string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def _made_documents(spark, n=260):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    made = [("u" if i % 9 else "v", i, 6, (base[i % 12] + 0.12 * rng.normal(size=6)).tolist()) for i in range(n)] + [("u", 900, 6, [0.0] * 6), ("u", 901, 2, [1.0, 0.0])]
    return made, spark.createDataFrame(made, "user_id string, document_id long, dim int, centroid array<double>").selectExpr("*", "timestamp_seconds((document_id * 37) % 50) AS created_at")


def test_near_duplicates_copies_for_tiles_not_blocks(spark):
    """A user's vectors are copied for each tile (12 for small ones), not for each of its blocks; cells and tiles lose no match."""
    made, d = _made_documents(spark)
    blocks = vectors._near_blocks(d, 4, vectors._cell_centres(d, 4))
    most = {r["user_id"]: (r["n"], r["t"]) for r in blocks.where("dim = 6").groupBy("user_id").agg(F.count("*").alias("n"), F.max("tiles").alias("t")).collect()}
    assert most["u"][0] > 50 and most["u"][1] <= vectors.TILES
    got = {r["document_id"]: r["duplicate_of"] for r in vectors.near_duplicates(d, block=4).collect()}
    key, cos = lambda i: ((i * 37) % 50, i), lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    want = {}
    for u, i, k, v in made:
        hits = [j for w, j, m, x in made if w == u and m == k and key(j) < key(i) and np.any(x) and np.any(v) and cos(v, x) > vectors.NEAR]
        if hits:
            want[i] = min(hits, key=key)
    assert got == want and len(want) > 50


def test_duplicates_of_new_copies_for_tiles(spark):
    made, d = _made_documents(spark)
    new, stored = d.where("document_id % 5 = 0"), d.where("document_id % 5 <> 0")
    assert vectors._near_blocks(stored, 4, None).agg(F.max("tiles")).first()[0] <= vectors.TILES
    got = {r["document_id"]: r["duplicate_of"] for r in vectors.duplicates_of_new(new, stored, block=4).collect()}
    key, cos = lambda i: ((i * 37) % 50, i), lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    want = {}
    for u, i, k, v in made:
        hits = [j for w, j, m, x in made if i % 5 == 0 and j % 5 and w == u and m == k and np.any(x) and np.any(v) and cos(v, x) > vectors.NEAR]
        if hits:
            want[i] = min(hits, key=key)
    assert got == want and len(want) > 10


def test_hybrid_retrieve_scans_texts_without_index_or_vectors(spark):
    """Chunks need neither vectors nor an index, and the results are those with both; groups with ties, common terms, empty texts."""
    rng = random.Random(4)
    words = "the of river stone lamp glass cloud engine the the".split()
    rows = [("a" if i % 3 else "b", i, " ".join(rng.choices(words, k=rng.randint(0, 9))) if i % 4 else "the river", round(rng.random(), 3)) for i in range(90)]
    c = spark.createDataFrame(rows, "`group` string, id long, content string, importance_score double")
    asked = [(1, "a", "the river of glass"), (2, "b", "unknown words"), (3, "a", ""), (4, "b", "stone stone lamp"), (5, "none", "river")]
    q = vectors.hash_embed(spark.createDataFrame(asked, "query_id long, `group` string, question string"), "question")
    scanned = retrieval.hybrid_retrieve(c, q, 2)
    indexed = retrieval.hybrid_retrieve(vectors.hash_embed(c), q.where("query_id <> 3"), 2, bm25.build(c))
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["ranked_score"], 5), round(r["sparse_score"], 5)) for r in df.collect())
    assert key(scanned.where("query_id <> 3")) == key(indexed) and {r["query_id"] for r in scanned.collect()} == {1, 2, 3, 4}
    assert key(retrieval.hybrid_retrieve(vectors.hash_embed(c), q, 2)) == key(scanned)


def test_record_retrievals_and_links_without_stored_vectors(spark):
    """Links between results are made of their contents alone."""
    from ragmill.plans import retrieval_queries

    r = spark.createDataFrame([(1, 1, "river stone"), (1, 2, "river stone"), (1, 3, "lamp"), (2, 1, "lamp")], "query_id long, rank long, content string")
    assert [(x["query_id"], x["a"], x["b"], x["weight"]) for x in retrieval_queries.links(r).collect()] == [(1, 1, 2, 1.0)]


def test_line_blocks_tell_headings_once(spark):
    """The heading rule stands once in the plan of line_blocks, not once for each field and each of its own parts."""
    d = spark.createDataFrame([("  OVERVIEW  \nMr. Smith came.  \nÜber Uns",)], "text string").select(chunking.line_blocks(F.col("text")).alias("b"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count(r"\P{L}") == 1
    assert [(x["heading"], x["level"], x["is_heading"]) for x in d.first()["b"]] == [("OVERVIEW", 1, True), (None, 0, False), ("Über Uns", 1, True)]
