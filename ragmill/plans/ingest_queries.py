"""Queries over ingest: blocks of files, checks of contents, model outputs, whole ingest, duplicates, exports and the answer log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragmill.functions import text as tx
from ragmill.operators import answers as an
from ragmill.operators import chunking, retrieval, vectors
from ragmill.operators import ingest as ing
from ragmill.plans.registry import query
from ragmill.plans.retrieval_queries import _EMB, HYBRID_SQL, K, asked, compare_results, links, results
from ragmill.plans.text_queries import CHUNKS_SQL
from ragmill.sources import io
from ragmill.sources.views import DOCS_SQL, LOG_SQL, documents, query_log, table

_TRIM = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"


@query("txt_blocks", f"""WITH p AS (SELECT conv_id, turn, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM (SELECT conv_id, turn, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS l FROM conversations) AS c)
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS block_no, {_TRIM} AS text, 1 AS page FROM p WHERE {_TRIM} <> ''""")
def txt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the turns as text files whose lines are set apart by blank ones."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(F.replace("text", F.lit("\n"), F.lit("\n\n")), "UTF-8").alias("content"))
    b = c.select("conv_id", "turn", F.posexplode(chunking.paragraph_blocks(io.decode_text(F.col("content")))).alias("block_no", "b"))
    return b.select("conv_id", "turn", F.col("block_no").cast("long").alias("block_no"), "b.text", "b.page")


@query("csv_blocks", """SELECT c_custkey, 0 AS row_no, 'c_custkey: ' || c_custkey || ', Column: ' || c_nationkey || ', name: ' || c_name || ', "' || c_mktsegment || '"' AS text FROM customer
  UNION ALL SELECT c_custkey, 1, 'c_custkey: ' || c_custkey FROM customer UNION ALL SELECT c_custkey, 2, 'segment: ' || c_mktsegment FROM customer WHERE c_mktsegment <> ''""")
def csv_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file a customer: an empty and a padded name, a quoted field, a short row, a row with empty and too many values."""
    file = F.format_string('c_custkey,, name ,segment\r\n%s,%s,"%s, ""%s""",\r\n%s\r\n,,,%s,beyond\r\n', *[F.col(c).cast("string") for c in ("c_custkey", "c_nationkey", "c_name", "c_mktsegment", "c_custkey", "c_mktsegment")])
    c = table(spark, sf_dir, "customer").select("c_custkey", file.alias("text"))
    return chunking.csv_blocks(c, ["c_custkey"])


@query("table_blocks", "SELECT s_suppkey, concat_ws(', ', 's_suppkey: ' || s_suppkey, CASE WHEN s_name <> '' THEN 's_name: ' || s_name END, 's_nationkey: ' || s_nationkey) AS text, 'supplier' AS heading FROM supplier")
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.table_blocks(table(spark, sf_dir, "supplier"), ["s_suppkey"], ["s_suppkey", "s_name", "s_nationkey"], "supplier")


@query("content_ok", """SELECT page_id, CASE page_id % 6 WHEN 1 THEN starts_with(ltrim(html), '%PDF-') WHEN 3 THEN starts_with(html, 'PK') WHEN 5 THEN false ELSE true END AS ok FROM pages""")
def content_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: with a PDF mark after spaces, none, a ZIP mark, none, as text, as text with a NUL byte."""
    k, html = F.col("page_id") % 6, F.encode("html", "UTF-8")
    mark = F.when(k == 0, F.unhex(F.lit("20200A255044462D"))).when(k == 2, F.unhex(F.lit("504B0304"))).when(k == 5, F.unhex(F.lit("6100"))).otherwise(F.unhex(F.lit("")))
    kind = F.when(k < 2, "pdf").when(k == 2, "docx").when(k == 3, "xlsx").when(k == 4, "txt").otherwise("csv")
    return table(spark, sf_dir, "pages").select("page_id", io.content_ok(F.concat(mark, html), kind).alias("ok"))


_MARKED = "===FOLLOWUPS==="


@query("split_followups", f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN {_TRIM.replace("(x", "(text")} ELSE text END AS answer, CASE WHEN turn % 2 = 0 THEN '["' || role || '"] {_MARKED} x' ELSE '' END AS rest FROM conversations""")
def split_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions with the marker twice in every second turn."""
    raw = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(f" \n{_MARKED}\n [\""), "role", F.lit(f"\"] {_MARKED} x\n"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.split_followups(raw).alias("s")).select("conv_id", "turn", "s.answer", "s.rest")


@query("parse_json_questions", f"""WITH w AS (SELECT conv_id, turn, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations) AS c),
  n AS (SELECT conv_id, turn, {_TRIM} AS q, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS o FROM w WHERE {_TRIM} <> '')
  SELECT conv_id, turn, string_agg(q, '|' ORDER BY o) AS questions FROM n WHERE o <= 4 GROUP BY 1, 2""")
def parse_json_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A completion whose array, bare or within prose, holds all words of the turn."""
    array = F.to_json(F.split("text", " ", -1))
    raw = F.when(F.col("turn") % 2 == 0, array).otherwise(F.concat(F.lit("Sure, here they are:\n"), array, F.lit("\nAnything else?")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.parse_json_questions(raw).alias("q")).where(F.size("q") > 0)
    return c.select("conv_id", "turn", F.array_join("q", "|").alias("questions"))


@query("parse_json_events", "SELECT conv_id, turn, '2020-' || turn AS date, substr(text, 1, 500) AS event, CAST(turn AS INTEGER) AS chunk_index FROM conversations WHERE text <> '' UNION ALL SELECT conv_id, turn, substr('in the year of ' || role || ' and after', 1, 20), role, 0 FROM conversations")
def parse_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A completion with an event of the whole turn, one without an index, one without a date."""
    first = F.to_json(F.struct(F.concat(F.lit("2020-"), F.col("turn").cast("string")).alias("date"), F.col("text").alias("event"), F.col("turn").alias("chunk_index")))
    second = F.to_json(F.struct(F.concat(F.lit("in the year of "), "role", F.lit(" and after")).alias("date"), F.col("role").alias("event")))
    raw = F.concat(F.lit("Events: ["), first, F.lit(", "), second, F.lit(', {"event": "undated"}] done'))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(tx.parse_json_events(raw)).alias("e"))
    return c.select("conv_id", "turn", "e.date", "e.event", "e.chunk_index")


@query("doc_centroid", "SELECT vec_id // 12 AS document_id, i AS pos, round(avg(v), 6) AS value FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) AS e WHERE vec_id % 12 < 10 GROUP BY 1, 2")
def doc_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks of documents of twelve chunks each."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 12).alias("document_id"), (F.col("vec_id") % 12).alias("chunk_index"), "embedding")
    c = vectors.doc_centroid(e).select("document_id", F.posexplode("centroid").alias("pos", "value"))
    return c.select("document_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


_PAIRS = f"""WITH {CHUNKS_SQL}, hd AS (SELECT * FROM chunks WHERE deleted_at IS NULL AND chunk_index < 10), {_EMB.format(p="c", k="id", t="content", f="hd")},
  ce AS (SELECT document_id, user_id, i, sum(v / n) AS v FROM hd JOIN cv ON cv.id = hd.id JOIN cn ON cn.id = hd.id GROUP BY 1, 2, 3),
  cl AS (SELECT document_id, sqrt(sum(v * v)) AS l FROM ce GROUP BY 1),
  pr AS (SELECT a.document_id, b.document_id AS duplicate_of, sum(a.v * b.v) AS d FROM ce AS a JOIN ce AS b ON b.user_id = a.user_id AND b.i = a.i AND {{}} GROUP BY 1, 2),
  cs AS (SELECT pr.document_id, duplicate_of, round(d / (la.l * lb.l), 12) AS s FROM pr JOIN cl AS la ON la.document_id = pr.document_id JOIN cl AS lb ON lb.document_id = duplicate_of)
  SELECT document_id, duplicate_of, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY duplicate_of) AS o FROM cs WHERE s > {vectors.NEAR}) AS q WHERE o = 1"""


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of the live documents' first ten chunks, made where the texts are read."""
    d = documents(spark, sf_dir).where("deleted_at IS NULL")
    return vectors.text_centroids(d.select("document_id", "user_id", "created_at", "text"), "text", lambda t: chunking.windows(t, most=10))


@query("near_duplicates", _PAIRS.format("b.document_id < a.document_id"))
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(centroids(spark, sf_dir))


@query("duplicates_of_new", _PAIRS.format("a.document_id % 3 = 0 AND b.document_id % 3 <> 0"))
def duplicates_of_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document is new, the others are stored."""
    c = centroids(spark, sf_dir)
    return vectors.duplicates_of_new(c.where("document_id % 3 = 0"), c.where("document_id % 3 <> 0"))


@query("mindmap_edges", f"""WITH {HYBRID_SQL}, v AS (SELECT query_id, rank, cv.i, cv.v / cn.n AS v FROM hy JOIN cv ON cv.id = hy.id JOIN cn ON cn.id = hy.id WHERE rank <= {K})
  SELECT query_id, 0 AS a, rank AS b, ranked_score AS weight FROM hy WHERE rank <= {K}
  UNION ALL SELECT a.query_id, a.rank, b.rank, round(sum(a.v * b.v), 4) FROM v AS a JOIN v AS b ON b.query_id = a.query_id AND b.i = a.i AND a.rank < b.rank GROUP BY 1, 2, 3 HAVING round(sum(a.v * b.v), 4) > 0.65""")
def mindmap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, q, r = results(spark, sf_dir)
    return an.mindmap(q, r, links(r))[1]


@query("answer_log")
def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows of all questions in the modes rag, multihop (the second question is that of the tenant's next query)
    and compare (three documents of the tenant)."""
    c, q, r = results(spark, sf_dir)
    q = q.select("query_id", "question")
    second = r.where("rank <= 5 AND query_id >= 20").withColumn("query_id", F.col("query_id") - 20)
    hops = ing.written(retrieval.multihop_merge(r.where("rank <= 5"), second).drop("round"), "hops")
    compared = compare_results(spark, sf_dir, c)
    answer = an.offline_compare_answer(q, compared)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("position", "rank")).cast("long")  # a few rows a query
    listed = ing.written(compared.withColumn("rank", order), "compared")
    log = an.answer_log(q, r, an.offline_answer(q, r), "rag")
    log = log.unionByName(an.answer_log(q, hops, an.offline_answer(q, hops), "multihop"))
    return log.unionByName(an.answer_log(q, listed, answer, "compare"))


@query("export_queries", f"WITH {LOG_SQL} SELECT user_id, id, question, mode, confidence_score, bookmarked, 'doc_' || k || '.txt' AS document_name, strftime(ts0, '%Y-%m-%dT%H:%M:%S') || 'Z' AS created_at FROM (SELECT *, date_trunc('second', created_at) AS ts0 FROM qlog) AS l WHERE deleted_at IS NULL")
def export_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported query rows with the name of their source."""
    e = io.exports(documents(spark, sf_dir), query_log(spark, sf_dir))["queries"]
    return e.select("user_id", "id", "question", "mode", "confidence_score", "bookmarked", F.col("sources")[0]["document_name"].alias("document_name"), "created_at")


@query("export_documents", f"WITH {DOCS_SQL} SELECT user_id, document_id AS id, filename, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS created_at FROM docs WHERE deleted_at IS NULL")
def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.exports(documents(spark, sf_dir), query_log(spark, sf_dir))["documents"].select("user_id", "id", "filename", "created_at")


@query("ingest_full")
def ingest_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents table of the whole ingest with sentence packing."""
    d = documents(spark, sf_dir).withColumn("blocks", chunking.line_blocks(F.col("text")))
    return ing.ingest(d)[0]
