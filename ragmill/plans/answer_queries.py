"""Queries over answers: grounding, confidence, citations, blocks, model inputs, graph and the ingest job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.functions import text as tx
from ragmill.operators import answers as an
from ragmill.operators import chunking, importance
from ragmill.plans.registry import query
from ragmill.plans.retrieval_queries import HYBRID_SQL, K, asked, compare_results, links, results
from ragmill.plans.text_queries import HIGHLIGHTS_SQL, IMPORTANCE_SQL, chunks
from ragmill.sources.views import documents, table

_CAPS = ", ".join(f"'{w}'" for w in tx.STOP_CAPS)
_WORDS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _terms(name: str, keys: str, text: str, source: str) -> str:
    """SQL of distinct key terms (keys, term) of a text column."""
    return f"""{name}r AS (SELECT {keys}, unnest(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {source}),
  {name}n AS (SELECT {keys}, unnest(regexp_extract_all({text}, '\\b[0-9][0-9,.%]*\\b')) AS w FROM {source}),
  {name} AS (SELECT {keys}, lower(w) AS term FROM {name}r WHERE regexp_full_match(w, '[A-Z][A-Za-z]{{2,}}') AND w NOT IN ({_CAPS})
    UNION SELECT {keys}, lower(w) FROM {name}r WHERE regexp_full_match(lower(w), '[a-z]{{5,}}') AND lower(w) NOT IN ({_WORDS})
    UNION SELECT {keys}, w FROM {name}n)"""


TURNS_SQL = """a AS (SELECT conv_id * 1000 + turn AS query_id, text AS answer FROM conversations WHERE role = 'assistant'),
  c AS (SELECT conv_id * 1000 + turn + k AS query_id, k AS rank, conv_id * 1000 + turn AS id, text AS content FROM conversations, (SELECT unnest([1, 2]) AS k) AS ks),
  s0 AS (SELECT query_id, string_split(regexp_replace(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM a),
  s AS (SELECT query_id, unnest(range(0, len(x))) AS sentence_no, unnest(x) AS sentence FROM s0)"""


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as answers, the two turns before as what was retrieved."""
    c = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1_000 + F.col("turn")
    a = c.where("role = 'assistant'").select(key.alias("query_id"), F.col("text").alias("answer"))
    r = c.select(key.alias("id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"), F.col("text").alias("content"))
    return a, r.withColumn("query_id", F.col("id") + F.col("rank"))


@query("grounding_check", f"""WITH {TURNS_SQL}, {_terms("st", "query_id, sentence_no", "sentence", "s")}, {_terms("ct", "query_id, rank, id", "content", "c")},
  h AS (SELECT st.query_id, sentence_no, rank, id FROM st JOIN ct ON ct.query_id = st.query_id AND ct.term = st.term GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3),
  f AS (SELECT query_id, sentence_no, min(rank) AS rank FROM h GROUP BY 1, 2), k AS (SELECT DISTINCT query_id, sentence_no FROM st)
  SELECT s.query_id, s.sentence_no, f.rank IS NOT NULL OR k.query_id IS NULL AS supported, h.id AS source_id FROM s LEFT JOIN f ON f.query_id = s.query_id AND f.sentence_no = s.sentence_no
    LEFT JOIN h ON h.query_id = f.query_id AND h.sentence_no = f.sentence_no AND h.rank = f.rank LEFT JOIN k ON k.query_id = s.query_id AND k.sentence_no = s.sentence_no WHERE s.sentence <> ''""")
def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, r = turns(spark, sf_dir)
    return an.grounding_check(a, r).select("query_id", F.col("sentence_no").cast("long").alias("sentence_no"), "supported", "source_id")


CONFIDENCE_SQL = f"""{HYBRID_SQL}, r AS (SELECT query_id, hy.id, rank, ranked_score, similarity_score, content FROM hy JOIN chunks AS ch ON ch.id = hy.id WHERE rank <= {K}),
  a AS (SELECT qs.query_id, CASE WHEN t IS NULL THEN '{an.NOTHING}' ELSE '{an.BASED.strip()}' || chr(10) || chr(10) || CASE WHEN length(t) > 600 THEN regexp_replace(substr(t, 1, 600), ' [^ ]*$', '') || '…' ELSE t END END AS answer
    FROM qs LEFT JOIN (SELECT query_id, content AS t FROM r WHERE rank = 1) AS x ON x.query_id = qs.query_id),
  s0 AS (SELECT query_id, string_split(regexp_replace(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM a),
  s AS (SELECT query_id, unnest(range(0, len(x))) AS sentence_no, unnest(x) AS sentence FROM s0), {_terms("zt", "query_id, sentence_no", "sentence", "s")}, {_terms("yt", "query_id, rank, id", "content", "r")},
  ok AS (SELECT DISTINCT query_id, sentence_no FROM (SELECT zt.query_id, sentence_no, rank FROM zt JOIN yt ON yt.query_id = zt.query_id AND yt.term = zt.term GROUP BY 1, 2, 3 HAVING count(*) >= 3) AS h),
  no AS (SELECT query_id, count(*) AS unsupported FROM (SELECT DISTINCT query_id, sentence_no FROM zt EXCEPT SELECT query_id, sentence_no FROM ok) AS u GROUP BY 1),
  m AS (SELECT query_id, avg(ranked_score) FILTER (WHERE rank <= 3) AS top3, max(similarity_score) FILTER (WHERE rank = 1) AS sim, count(*) AS n FROM r GROUP BY 1),
  cf AS (SELECT a.query_id, answer, coalesce(unsupported, 0) AS unsupported, round(CASE WHEN n IS NULL THEN 0 WHEN sim < 0.4 THEN least(0.35, sim) ELSE
      least(1, greatest(0, 0.5 * top3 + 0.3 * sim + 0.2 * (1 - least(0.5, 2 * coalesce(unsupported, 0) / len(string_split(answer, '. ')))) + least(0.1, 0.02 * n))) END, 4) AS confidence
    FROM a LEFT JOIN m ON m.query_id = a.query_id LEFT JOIN no ON no.query_id = a.query_id)"""


@query("confidence", f"WITH {CONFIDENCE_SQL} SELECT query_id, confidence FROM cf")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of the extractive answers, less what their unsupported sentences cost."""
    _, q, r = results(spark, sf_dir)
    a = an.offline_answer(q, r)
    return an.confidence(q, r, a, an.grounding_check(a, r))


@query("answer_queries", f"WITH {CONFIDENCE_SQL} SELECT query_id, answer, confidence, CAST(unsupported AS BIGINT) AS unsupported FROM cf")
def answer_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bulk job: retrieve, answer, check, confidence."""
    _, q, r = results(spark, sf_dir)
    a = an.offline_answer(q, r)
    g = an.grounding_check(a, r)
    bad = g.groupBy("query_id").agg(F.sum(F.when(F.col("supported"), 0).otherwise(1)).alias("unsupported"))
    return a.join(an.confidence(q, r, a, g), "query_id").join(bad, "query_id", "left").select("query_id", "answer", "confidence", "unsupported")


@query("prompt_context", f"WITH {HYBRID_SQL} SELECT query_id, md5(string_agg('[' || rank || '] ' || content, chr(10) || chr(10) ORDER BY rank)) AS digest FROM hy JOIN chunks AS c ON c.id = hy.id WHERE rank <= {K} GROUP BY 1")
def prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.prompt_context(results(spark, sf_dir)[2]).select("query_id", F.md5("context").alias("digest"))


@query("citations", "SELECT conv_id AS query_id, CAST(turn AS INTEGER) AS n, 2 AS times, turn >= 1 AND turn <= 3 AS valid FROM conversations")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite the number of each of their turns twice, with three sources each."""
    c = table(spark, sf_dir, "conversations")
    mark = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] x ["), F.col("turn").cast("string"), F.lit("]"))
    a = c.groupBy(F.col("conv_id").alias("query_id")).agg(F.array_join(F.collect_list(mark), " ").alias("answer"))
    s = c.select(F.col("conv_id").alias("query_id")).distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return an.citation_counts(a, s).withColumn("times", F.col("times").cast("int"))


@query("answer_blocks", """WITH l AS (SELECT query_id, unnest(range(len(x))) AS i, regexp_replace(unnest(x), '^\\s+|\\s+$', '', 'g') AS s
    FROM (SELECT conv_id * 1000 + turn AS query_id, string_split('## Turn ' || turn || chr(10) || coalesce(text, '') || chr(10) || '- one' || chr(10) || '- two', chr(10)) AS x FROM conversations) AS q),
  k AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN starts_with(s, '## ') OR starts_with(s, '### ') THEN 'heading' WHEN starts_with(s, '- ') THEN 'list' ELSE 'paragraph' END AS kind FROM l),
  g AS (SELECT *, sum(CASE WHEN kind IN ('list', 'paragraph') AND kind = before THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY i) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY query_id ORDER BY i) AS before FROM k) AS b),
  b AS (SELECT query_id, run, kind, string_agg(CASE kind WHEN 'heading' THEN regexp_replace(s, '^#+ ', '') WHEN 'list' THEN substr(s, 3) ELSE s END, ' ' ORDER BY i) AS text FROM g WHERE kind <> 'blank' GROUP BY 1, 2, 3)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY run) AS block_no, kind, text FROM b""")
def answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every turn's whole text under a heading, with a list after it."""
    c = table(spark, sf_dir, "conversations")
    a = c.select((F.col("conv_id") * 1_000 + F.col("turn")).alias("query_id"), F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n- one\n- two")).alias("answer"))
    return an.answer_blocks(a)


@query("highlight_inputs", f"""WITH {HIGHLIGHTS_SQL} SELECT document_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank) FILTER (WHERE rank <= 5) AS summary_input,
  string_agg('(chunk ' || chunk_index || ') ' || substr(text, 1, 200), chr(10) ORDER BY rank) AS timeline_input FROM hl GROUP BY 1""")
def highlight_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.highlight_inputs(importance.highlights(importance.chunk_importance(chunks(spark, sf_dir))))


@query("chunk_graph", f"""WITH {HYBRID_SQL}, v AS (SELECT query_id, rank, cv.i, cv.v / cn.n AS v FROM hy JOIN cv ON cv.id = hy.id JOIN cn ON cn.id = hy.id WHERE rank <= {K})
  SELECT a.query_id, a.rank AS a, b.rank AS b, round(sum(a.v * b.v), 4) AS weight FROM v AS a JOIN v AS b ON b.query_id = a.query_id AND b.i = a.i AND a.rank < b.rank GROUP BY 1, 2, 3 HAVING round(sum(a.v * b.v), 4) > 0.65""")
def chunk_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(results(spark, sf_dir)[2])


@query("offline_compare_answer")
def offline_compare_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.offline_compare_answer(asked(spark, sf_dir), compare_results(spark, sf_dir))


@query("ingest_documents", f"WITH {IMPORTANCE_SQL}, k AS (SELECT document_id, count(*) AS chunks, round(max(importance_score), 6) AS top FROM imp GROUP BY 1) SELECT d.document_id, coalesce(chunks, 0) AS chunks, top AS top_importance, CASE WHEN chunks IS NULL THEN 'failed' ELSE 'done' END AS status, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words FROM docs AS d LEFT JOIN k ON k.document_id = d.document_id")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk, score and sum up every document; one without text is a failed row."""
    d = documents(spark, sf_dir)
    k = importance.chunk_importance(chunking.chunk_text(d, ["document_id"])).groupBy("document_id").agg(F.count("*").alias("chunks"), F.round(F.max("importance_score"), 6).alias("top_importance"))
    out = d.select("document_id", tx.count_words(F.col("text")).alias("words")).join(k, "document_id", "left")
    return out.select("document_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), "top_importance", F.when(F.col("chunks").isNull(), "failed").otherwise("done").alias("status"), "words")
