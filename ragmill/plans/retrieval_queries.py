"""Queries over vectors, retrieval and answers: benchmark texts are the questions, a source is a tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.operators import answers as an
from ragmill.operators import bm25, importance, retrieval, vectors
from ragmill.plans.registry import query
from ragmill.plans.text_queries import CHUNKS_SQL, IMPORTANCE_SQL, chunks
from ragmill.session import written
from ragmill.sources.views import documents, table

K = retrieval.TOP
LIMIT = K * retrieval.MULTIPLE
Q_SQL = """qs AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS "group", text AS question FROM benchmark)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("group"), F.col("text").alias("question"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of live documents with group, id and importance; vectors are made of the contents where they are needed."""
    c = importance.chunk_importance(chunks(spark, sf_dir)).where(F.col("deleted_at").isNull())
    c = c.select(F.col("user_id").alias("group"), "id", "document_id", "chunk_index", F.col("filename").alias("document_name"), "content", "importance_score")
    return written(c, "corpus")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(vectors.hash_embed(questions(spark, sf_dir), "question"), "questions")


_EMB = """{p}t AS (SELECT {k}, unnest(regexp_extract_all(lower({t}), '[a-z0-9]+')) AS w FROM {f}),
  {p}v AS (SELECT {k}, i, sum(CASE WHEN i >= 256 THEN 1.0 ELSE -1.0 END) AS v FROM (SELECT {k}, CAST('0x' || right(md5(w), 3) AS INTEGER) % 512 AS i FROM {p}t) AS x GROUP BY 1, 2),
  {p}n AS (SELECT {k}, sqrt(sum(v * v)) AS n FROM {p}v GROUP BY 1)"""


@query("hash_embed", "WITH " + _EMB.format(p="d", k="doc_id", t="text", f="documents") + " SELECT v.doc_id, i AS dim, round(v / n, 9) AS value FROM dv AS v JOIN dn AS n ON n.doc_id = v.doc_id")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vectors.hash_embed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.posexplode("embedding").alias("dim", "value")).where("value <> 0").select("doc_id", "dim", F.round("value", 9).alias("value"))


@query("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, "a").select("a", "b", F.round(vectors.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


_TOPK = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS similarity
  FROM embeddings AS q, embeddings AS v WHERE q.vec_id % 20 = 0) SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id DESC) AS rank FROM s) AS r WHERE rank <= 8"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "group", "embedding")


@query("dense_topk", _TOPK)
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return vectors.dense_topk(v, q, 8, by_group=False).withColumn("similarity", F.round("similarity", 6))


@query("ann_candidates")
def ann_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return vectors.ann_candidates(v, q, 8)


@query("ann_recall", "SELECT count(*) AS queries, 8 AS k, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact top 8 that the inverted lists find: is it 0.9 at least?"""
    v, q = _vectors(spark, sf_dir)
    exact = vectors.dense_topk(v, q, 8, by_group=False).select("query_id", "id")
    found = vectors.ann_candidates(v, q, 8).select("query_id", "id", F.lit(1).alias("found"))
    both = exact.join(found, ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.lit(8).alias("k"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


BM25_SQL = """t AS (SELECT user_id AS "group", id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM chunks WHERE deleted_at IS NULL),
  ln AS (SELECT user_id AS "group", id, len(regexp_extract_all(lower(content), '[a-z0-9]+')) AS len FROM chunks WHERE deleted_at IS NULL),
  sz AS (SELECT "group", count(*) AS n, avg(len) AS avgdl FROM ln GROUP BY 1),
  po AS (SELECT "group", term, id, count(*) AS tf FROM t GROUP BY 1, 2, 3),
  df AS (SELECT "group", term, count(*) AS df FROM po GROUP BY 1, 2),
  rw0 AS (SELECT df."group", term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df JOIN sz ON sz."group" = df."group"),
  mn AS (SELECT "group", avg(raw) AS m FROM rw0 GROUP BY 1),
  idf AS (SELECT rw0."group", term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM rw0 JOIN mn ON mn."group" = rw0."group"),
  qtm AS (SELECT query_id, "group", term, count(*) AS qf FROM (SELECT query_id, "group", unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM qs) AS x GROUP BY 1, 2, 3),
  sc AS (SELECT query_id, po.id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) AS score
    FROM qtm JOIN idf ON idf."group" = qtm."group" AND idf.term = qtm.term JOIN po ON po."group" = qtm."group" AND po.term = qtm.term JOIN ln ON ln.id = po.id JOIN sz ON sz."group" = qtm."group" GROUP BY 1, 2),
  al AS (SELECT qs.query_id, ln.id, coalesce(sc.score, 0) AS score FROM qs JOIN ln ON ln."group" = qs."group" LEFT JOIN sc ON sc.query_id = qs.query_id AND sc.id = ln.id),
  mm AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM al GROUP BY 1),
  sp AS (SELECT al.query_id, id, round(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (score - lo) / (hi - lo) END, 9) AS sparse_score FROM al JOIN mm ON mm.query_id = al.query_id),
  spr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, id DESC) AS rank FROM sp)"""


@query("bm25_index", f"WITH {CHUNKS_SQL}, {Q_SQL}, {BM25_SQL} SELECT \"group\", term, round(idf, 6) AS idf FROM idf")
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).where("deleted_at IS NULL").select(F.col("user_id").alias("group"), "id", "content")
    return bm25.build(c).idf().select("group", "term", F.round("idf", 6).alias("idf"))


@query("bm25_search", f"WITH {CHUNKS_SQL}, {Q_SQL}, {BM25_SQL} SELECT query_id, id, round(sparse_score, 6) AS sparse_score, rank FROM spr WHERE rank <= {K}")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).where("deleted_at IS NULL").select(F.col("user_id").alias("group"), "id", "content")
    return retrieval.bm25_search(bm25.build(c), questions(spark, sf_dir), K).withColumn("sparse_score", F.round("sparse_score", 6))


HYBRID_SQL = (
    CHUNKS_SQL + ", " + IMPORTANCE_SQL[len(CHUNKS_SQL) + 2 :] + f", {Q_SQL}, {BM25_SQL}, " + _EMB.format(p="c", k="id", t="content", f="chunks") + ", " + _EMB.format(p="q", k="query_id", t="question", f="qs")
    + f""", dn0 AS (SELECT qs.query_id, ln.id FROM qs JOIN ln ON ln."group" = qs."group"),
  dt AS (SELECT qv.query_id, cv.id, sum(qv.v * cv.v) AS d FROM qs JOIN qv ON qv.query_id = qs.query_id JOIN ln ON ln."group" = qs."group" JOIN cv ON cv.id = ln.id AND cv.i = qv.i GROUP BY 1, 2),
  ds AS (SELECT dn0.query_id, dn0.id, round(coalesce(d / (qn.n * cn.n), 0), 9) AS dense FROM dn0 LEFT JOIN dt ON dt.query_id = dn0.query_id AND dt.id = dn0.id LEFT JOIN qn ON qn.query_id = dn0.query_id LEFT JOIN cn ON cn.id = dn0.id),
  dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, id DESC) AS rank FROM ds),
  ca AS (SELECT query_id, id FROM dr WHERE rank <= {LIMIT} UNION SELECT query_id, id FROM spr WHERE rank <= {LIMIT}),
  cs AS (SELECT ca.query_id, ca.id, dense, sparse_score AS sparse, importance_score AS importance FROM ca JOIN ds ON ds.query_id = ca.query_id AND ds.id = ca.id JOIN sp ON sp.query_id = ca.query_id AND sp.id = ca.id JOIN imp ON imp.id = ca.id),
  fu AS (SELECT *, round((0.6 * CASE WHEN max(dense) OVER w - min(dense) OVER w < 1e-12 THEN 0 ELSE (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) END
      + 0.4 * CASE WHEN max(sparse) OVER w - min(sparse) OVER w < 1e-12 THEN 0 ELSE (sparse - min(sparse) OVER w) / (max(sparse) OVER w - min(sparse) OVER w) END) * (1 + 0.2 * importance), 6) AS ranked_score FROM cs WINDOW w AS (PARTITION BY query_id)),
  hy AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY ranked_score DESC, id DESC) AS rank, round(greatest(0, dense), 6) AS similarity_score, round(sparse, 6) AS sparse_score, round(importance, 6) AS importance_score, ranked_score FROM fu)"""
)


def results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, q = corpus(spark, sf_dir), asked(spark, sf_dir)
    r = written(retrieval.hybrid_retrieve(c, q), "results")
    return c, q, written(r.join(c.select("id", "document_id", "document_name", "content"), "id"), "result-texts")


def links(r: DataFrame) -> DataFrame:
    """Pairs of each question's results with similar contents."""
    v = written(vectors.hash_embed(r.select("query_id", F.col("rank").alias("pos"), "content")).drop("content"), "result-vectors")
    return vectors.similar_pairs(v, "query_id", 0.65)


@query("hybrid_retrieve", f"WITH {HYBRID_SQL} SELECT * FROM hy WHERE rank <= {K}")
def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid_retrieve(corpus(spark, sf_dir), asked(spark, sf_dir))


@query("build_sources", f"""WITH {HYBRID_SQL}, x AS (SELECT query_id, rank AS n, filename AS title, replace(content, chr(10), ' ') AS t, ranked_score, similarity_score, importance_score FROM hy JOIN chunks AS c ON c.id = hy.id WHERE rank <= {K})
  SELECT query_id, n, title, CASE WHEN length(t) > 240 THEN CASE WHEN contains(substr(t, 1, 240), ' ') THEN regexp_replace(substr(t, 1, 240), ' [^ ]*$', '') ELSE substr(t, 1, 240) END || '…' ELSE t END AS snippet,
    CAST(round_even(least(1, ranked_score) * 100, 0) AS INTEGER) AS relevance_pct, round(similarity_score, 4) AS similarity_score, round(importance_score, 4) AS importance_score FROM x""")
def build_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.build_sources(results(spark, sf_dir)[2])


@query("offline_answer", f"""WITH {HYBRID_SQL}, x AS (SELECT query_id, content AS t FROM hy JOIN chunks AS c ON c.id = hy.id WHERE rank = 1)
  SELECT qs.query_id, CASE WHEN t IS NULL THEN '{an.NOTHING}' ELSE '{an.BASED.strip()}' || chr(10) || chr(10) || CASE WHEN length(t) > 600 THEN regexp_replace(substr(t, 1, 600), ' [^ ]*$', '') || '…' ELSE t END END AS answer FROM qs LEFT JOIN x ON x.query_id = qs.query_id""")
def offline_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, r = results(spark, sf_dir)
    return an.offline_answer(q, r)


@query("record_retrievals", f"WITH {HYBRID_SQL} SELECT id, CAST(count(*) AS BIGINT) AS retrieved_count FROM hy WHERE rank <= {K} GROUP BY 1")
def record_retrievals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, r = results(spark, sf_dir)
    stored = spark.createDataFrame([], "id long, retrieved_count long, last_at timestamp")
    return an.record_retrievals(r, stored, "2024-02-01 00:00:00").select("id", "retrieved_count")


@query("minmax_by_label", "SELECT vec_id, round(CASE WHEN max(x) OVER w - min(x) OVER w < 1e-12 THEN 0 ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END, 6) AS scaled FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) AS e WINDOW w AS (PARTITION BY label)")
def minmax_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(importance.minmax(F.col("embedding")[0].cast("double"), Window.partitionBy("label"), 0.0), 6).alias("scaled"))


@query("mindmap_nodes", f"WITH {HYBRID_SQL} SELECT query_id, 'query' AS kind, 0 AS node, substr(regexp_replace(question, '^\\s+|\\s+$', '', 'g'), 1, 50) AS label FROM qs UNION ALL SELECT query_id, 'chunk', rank, regexp_replace(substr(content, 1, 60), '^\\s+|\\s+$', '', 'g') FROM hy JOIN chunks AS c ON c.id = hy.id WHERE rank <= {K}")
def mindmap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, r = results(spark, sf_dir)
    return an.mindmap(q, r, links(r))[0]


CHOSEN_SQL = "ch AS (SELECT query_id, document_id, o AS position FROM (SELECT qs.query_id, d.document_id, row_number() OVER (PARTITION BY qs.query_id ORDER BY d.document_id) AS o FROM qs JOIN docs AS d ON d.user_id = qs.\"group\" WHERE deleted_at IS NULL) AS x WHERE o <= 3)"
_SCORED = """ca2 AS (SELECT ch.query_id, ch.document_id, ch.position, c.id FROM ch JOIN chunks AS c ON c.document_id = ch.document_id),
  cs2 AS (SELECT ca2.*, dense, sparse_score AS sparse, importance_score AS importance FROM ca2 JOIN ds ON ds.query_id = ca2.query_id AND ds.id = ca2.id JOIN sp ON sp.query_id = ca2.query_id AND sp.id = ca2.id JOIN imp ON imp.id = ca2.id),
  fu2 AS (SELECT *, round((0.6 * CASE WHEN max(dense) OVER w - min(dense) OVER w < 1e-12 THEN 0 ELSE (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) END
      + 0.4 * CASE WHEN max(sparse) OVER w - min(sparse) OVER w < 1e-12 THEN 0 ELSE (sparse - min(sparse) OVER w) / (max(sparse) OVER w - min(sparse) OVER w) END) * (1 + 0.2 * importance), 6) AS ranked_score FROM cs2 WINDOW w AS (PARTITION BY {by})),
  hy2 AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ranked_score DESC, id DESC) AS rank FROM fu2)"""


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of each question's tenant, in id order."""
    from pyspark.sql import Window

    d = documents(spark, sf_dir).where("deleted_at IS NULL").select(F.col("user_id").alias("group"), "document_id")
    d = d.withColumn("position", F.row_number().over(Window.partitionBy("group").orderBy("document_id")).cast("long")).where("position <= 3")
    return questions(spark, sf_dir).select("query_id", "group").join(d, "group").drop("group")


@query("compare_retrieve", f"WITH {HYBRID_SQL}, {CHOSEN_SQL}, {_SCORED.format(by='query_id, document_id')} SELECT query_id, document_id, position, id, rank, ranked_score FROM hy2 WHERE rank <= 4")
def compare_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.compare_retrieve(corpus(spark, sf_dir), asked(spark, sf_dir), chosen(spark, sf_dir))
    return out.select("query_id", "document_id", "position", "id", "rank", "ranked_score")


def compare_results(spark: SparkSession, sf_dir: str, c: DataFrame | None = None) -> DataFrame:
    c = corpus(spark, sf_dir) if c is None else c
    out = retrieval.compare_retrieve(c, asked(spark, sf_dir), chosen(spark, sf_dir))
    return written(written(out, "compared-ids").join(c.select("id", "document_name", "content"), "id"), "compared-texts")


@query("scope_rows", f"WITH {HYBRID_SQL}, {CHOSEN_SQL}, {_SCORED.format(by='query_id')} SELECT query_id, id, rank, ranked_score FROM hy2 WHERE rank <= {K}")
def scope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.scoped_retrieve(corpus(spark, sf_dir), asked(spark, sf_dir), chosen(spark, sf_dir).select("query_id", "document_id"))
    return out.select("query_id", "id", "rank", "ranked_score")


@query("multihop_merge", f"""WITH {HYBRID_SQL}, one AS (SELECT query_id, id, ranked_score, rank FROM hy WHERE rank <= 5), two AS (SELECT query_id - 20 AS query_id, id, ranked_score, rank FROM hy WHERE rank <= 5 AND query_id >= 20),
  b AS (SELECT *, 1 AS round FROM one UNION ALL SELECT *, 2 AS round FROM two), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY ranked_score DESC, round) AS o FROM b)
  SELECT query_id, id, round, ranked_score, rank FROM (SELECT query_id, id, round, ranked_score, row_number() OVER (PARTITION BY query_id ORDER BY ranked_score DESC, id DESC) AS rank FROM p WHERE o = 1) AS q WHERE rank <= {K}""")
def multihop_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second question of a query is that of the same tenant's next query."""
    r = results(spark, sf_dir)[2].where("rank <= 5").select("query_id", "id", "rank", "ranked_score")
    second = r.where("query_id >= 20").withColumn("query_id", F.col("query_id") - 20)
    return retrieval.multihop_merge(r, second).select("query_id", "id", "round", "ranked_score", "rank")


@query("candidate_union", f"WITH {HYBRID_SQL} SELECT query_id, id FROM ca")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, q = corpus(spark, sf_dir), asked(spark, sf_dir)
    a = vectors.dense_topk(vectors.hash_embed(c), q, LIMIT).select("query_id", "id")
    return a.unionByName(retrieval.bm25_search(bm25.build(c), q, LIMIT).select("query_id", "id")).distinct()


@query("corpus_capped", f"WITH {CHUNKS_SQL} SELECT user_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY document_id DESC, id DESC) AS r FROM chunks WHERE deleted_at IS NULL) AS q WHERE r <= 50")
def corpus_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 chunks of each user."""
    return retrieval.corpus(chunks(spark, sf_dir), documents(spark, sf_dir), 50).select("user_id", "id")


@query("compare_errors", "SELECT item_id AS query_id, 'Compare mode requires at least 2 selected documents.' AS error FROM benchmark WHERE item_id % 4 < 2")
def compare_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question i chooses i % 4 documents."""
    q = questions(spark, sf_dir).select("query_id")
    picked = q.select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("document_id")).where(F.col("document_id") <= F.col("query_id") % 4)
    return retrieval.compare_errors(q, picked)
