"""Answers in bulk: sources, extractive answers, grounding, confidence, counters and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import citations, cut_on_space, key_terms, simple_sentences, snippet, strip

#: The sentences of the extractive answers.
NOTHING = "I could not find anything relevant in the provided documents to answer that question."
COMPARE_NOTHING = "I could not find anything relevant in the selected documents to compare."
COMPARE_TOP = "[offline mode] Top passage from each selected document:"
BASED = "[offline mode] Based on the most relevant passage in your documents [1]:\n\n"


def build_sources(results: DataFrame) -> DataFrame:
    """Source cards of results (query_id, rank, document_name, content and scores)."""
    pct = F.bround(F.least(F.lit(1.0), F.col("ranked_score")) * 100).cast("int")
    return results.select("query_id", F.col("rank").alias("n"), F.col("document_name").alias("title"), snippet(F.col("content")).alias("snippet"), pct.alias("relevance_pct"), F.round("similarity_score", 4).alias("similarity_score"), F.round("importance_score", 4).alias("importance_score"))


def offline_answer(queries: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, answer: the top passage of at most 600 characters, or a fixed sentence."""
    top = results.where(F.col("rank") == 1).select("query_id", cut_on_space(strip(F.col("content")), 600).alias("_p"))
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", F.coalesce(F.concat(F.lit(BASED), F.col("_p")), F.lit(NOTHING)).alias("answer"))


def prompt_context(results: DataFrame) -> DataFrame:
    """Numbered passages of each query joined by blank lines; a query has at most a few results."""
    p = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("content"))
    return results.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", p.alias("p")))), lambda x: x["p"]), "\n\n").alias("context"))


def compare_context(results: DataFrame) -> DataFrame:
    """query_id, context: passages under "Document: name" in chosen order, numbered over all documents. Of chosen documents with
    one name only the last one's passages stand there, in the first one's place. results: query_id, position, rank,
    document_name, content."""
    name = Window.partitionBy("query_id", "document_name")
    kept = results.withColumn("_slot", F.min("position").over(name)).withColumn("_last", F.max("position").over(name)).where(F.col("position") == F.col("_last"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("_slot", "rank"))
    line = F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.col("content"))
    parts = kept.select("query_id", "_slot", "document_name", n.alias("_n"), line.alias("_line")).groupBy("query_id", "_slot", "document_name").agg(F.sort_array(F.collect_list(F.struct("_n", "_line"))).alias("_p"))
    part = F.concat(F.lit("Document: "), F.col("document_name"), F.lit("\n"), F.array_join(F.transform("_p", lambda x: x["_line"]), "\n"))
    by_slot = F.sort_array(F.collect_list(F.struct("_slot", part.alias("t"))))
    return parts.groupBy("query_id").agg(strip(F.array_join(F.transform(by_slot, lambda x: x["t"]), "\n\n")).alias("context"))


def grounding_check(answers: DataFrame, results: DataFrame, least: int = 3) -> DataFrame:
    """Sentences of each answer, whether a retrieved chunk shares `least` key terms, and the first such by rank."""
    s = answers.select("query_id", F.posexplode(simple_sentences(F.col("answer"))).alias("sentence_no", "sentence")).withColumn("_t", key_terms(F.col("sentence")))
    c = results.select("query_id", "rank", "id", key_terms(F.col("content")).alias("_c"))
    hit = s.join(c, "query_id").where(F.size(F.array_intersect("_t", "_c")) >= least).groupBy("query_id", "sentence_no").agg(F.min_by("id", "rank").alias("source_id"))
    out = s.join(hit, ["query_id", "sentence_no"], "left")
    return out.select("query_id", "sentence_no", "sentence", (F.col("source_id").isNotNull() | (F.size("_t") == 0)).alias("supported"), "source_id")


def confidence(queries: DataFrame, results: DataFrame, answers: DataFrame, grounding: DataFrame) -> DataFrame:
    """query_id, confidence in 0..1 from rank scores, the top similarity, unsupported sentences and coverage."""
    r = results.groupBy("query_id").agg(F.avg(F.when(F.col("rank") <= 3, F.col("ranked_score"))).alias("top3"), F.max(F.when(F.col("rank") == 1, F.col("similarity_score"))).alias("sim"), F.count("*").alias("n"))
    u = grounding.groupBy("query_id").agg(F.sum(F.when(F.col("supported"), 0).otherwise(1)).alias("unsupported"))
    a = answers.select("query_id", F.size(F.split("answer", r"\. ", -1)).alias("sents"))
    j = queries.select("query_id").join(r, "query_id", "left").join(u, "query_id", "left").join(a, "query_id", "left")
    bad = F.least(F.lit(0.5), 2 * F.coalesce("unsupported", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("sents", F.lit(1))))
    raw = 0.5 * F.col("top3") + 0.3 * F.col("sim") + 0.2 * (1 - bad) + F.least(F.lit(0.1), 0.02 * F.col("n"))
    value = F.when(F.col("n").isNull(), 0.0).when(F.col("sim") < 0.4, F.least(F.lit(0.35), F.col("sim"))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    return j.select("query_id", F.round(value, 4).alias("confidence"))


def answer_log(queries: DataFrame, results: DataFrame, answers: DataFrame, mode: str, conf: DataFrame | None = None) -> DataFrame:
    """A history row for each query: query_id, user_id, question, answer, mode, sources_json (null without results) and
    confidence_score. The sources are a compact snapshot in rank order, with page and section if results have them; a query
    has at most a few results. user_id is null if queries have none."""
    r = results.withColumn("ranked_score", F.bround(F.least(F.lit(1.0), F.col("ranked_score")) * 100) / 100)
    place = [(F.col(n) if n in results.columns else F.lit(None).cast(kind)).alias(n) for n, kind in (("page_number", "int"), ("section_heading", "string"))]
    card = F.struct("rank", "document_id", F.col("id").alias("chunk_id"), "document_name", *place, "ranked_score", F.round("importance_score", 4).alias("importance_score"))
    fields = lambda x: F.struct(*[x[n].alias(n) for n in ("chunk_id", "document_id", "document_name", "page_number", "section_heading", "ranked_score", "importance_score")])
    s = r.groupBy("query_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(card)), fields)).alias("sources_json"))
    if conf is None:
        conf = confidence(queries, results, answers, grounding_check(answers, results))
    user = F.col("user_id") if "user_id" in queries.columns else F.lit(None).cast("string")
    out = queries.select("query_id", user.alias("user_id"), "question").join(answers, "query_id", "left").join(s, "query_id", "left").join(conf, "query_id", "left")
    return out.select("query_id", "user_id", "question", "answer", F.lit(mode).alias("mode"), "sources_json", F.coalesce("confidence", F.lit(0.0)).alias("confidence_score"))


def citation_counts(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Cited source numbers of each answer and whether they exist."""
    c = answers.select("query_id", F.explode(citations(F.col("answer"))).alias("n")).groupBy("query_id", "n").agg(F.count("*").alias("times"))
    top = sources.groupBy("query_id").agg(F.count("*").alias("_k"))
    return c.join(top, "query_id", "left").select("query_id", "n", "times", ((F.col("n") >= 1) & (F.col("n") <= F.coalesce("_k", F.lit(0)))).alias("valid"))


def record_retrievals(results: DataFrame, stored: DataFrame, at: str) -> DataFrame:
    """Merge new retrievals (one more per returned chunk) into stored counts (id, retrieved_count, last_at)."""
    new = results.groupBy("id").agg(F.count("*").alias("_n"))
    out = stored.join(new, "id", "full_outer")
    return out.select("id", (F.coalesce("retrieved_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("retrieved_count"), F.greatest("last_at", F.when(F.col("_n").isNotNull(), F.lit(at).cast("timestamp"))).alias("last_at"))


def mindmap(queries: DataFrame, results: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (query and chunks) and edges (query to chunk by rank, chunk to chunk by weight) of each query. A chunk is
    labelled by its section_heading, if results have one, else by the start of its text."""
    q = queries.select("query_id", F.lit("query").alias("kind"), F.lit(0).cast("long").alias("node"), F.substring(strip(F.col("question")), 1, 50).alias("label"))
    head = F.nullif("section_heading", F.lit("")) if "section_heading" in results.columns else F.lit(None).cast("string")
    c = results.select("query_id", F.lit("chunk").alias("kind"), F.col("rank").alias("node"), strip(F.coalesce(head, F.substring("content", 1, 60))).alias("label"))
    e = results.select("query_id", F.lit(0).cast("long").alias("a"), F.col("rank").alias("b"), "ranked_score").withColumnRenamed("ranked_score", "weight")
    return q.unionByName(c), e.unionByName(links)


def answer_assembly(frames: DataFrame) -> DataFrame:
    """One answer per query from its token frames (query_id, seq, kind, text), complete once `done` has come."""
    t = F.sort_array(F.collect_list(F.when(F.col("kind") == "token", F.struct("seq", "text"))))
    return frames.groupBy("query_id").agg(F.array_join(F.transform(t, lambda x: x["text"]), "").alias("answer"), F.max((F.col("kind") == "done").cast("int")).alias("complete"))


def last_per(rows: DataFrame, by: str, order: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def offline_compare_answer(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Top passage (at most 300 characters) of each compared document in chosen order, numbered over the documents that
    have one; a query without any has a fixed sentence. results: query_id, position, rank, document_name, content."""
    top = results.where(F.col("rank") == 1).select("query_id", F.struct("position", "document_name", cut_on_space(strip(F.col("content")), 300).alias("passage")).alias("p"))
    line = lambda x, i: F.concat(F.lit("\n\n**"), x["document_name"], F.lit("** ["), (i + 1).cast("string"), F.lit("]: "), x["passage"])
    found = top.groupBy("query_id").agg(F.concat(F.lit(COMPARE_TOP), F.array_join(F.transform(F.sort_array(F.collect_list("p")), line), "")).alias("answer"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(COMPARE_NOTHING)).alias("answer"))


def highlight_inputs(highlights: DataFrame, first: int = 5, timeline: int = 20) -> DataFrame:
    """Model inputs of each document from its highlights in rank order: summary_input and timeline_input."""
    h = highlights.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_index", "text"))).alias("h"))
    line = lambda x: F.concat(F.lit("(chunk "), x["chunk_index"].cast("string"), F.lit(") "), F.substring(x["text"], 1, 200))
    return h.select(
        "document_id",
        F.array_join(F.transform(F.slice("h", 1, first), lambda x: x["text"]), "\n---\n").alias("summary_input"),
        F.array_join(F.transform(F.slice("h", 1, timeline), line), "\n").alias("timeline_input"),
    )


def answer_blocks(answers: DataFrame) -> DataFrame:
    """Markdown lines of each answer as blocks (query_id, block_no, kind, text): headings, list runs, paragraphs."""
    s = answers.select("query_id", F.posexplode(F.split("answer", "\n", -1)).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    kind = F.when(F.col("line") == "", "blank").when(F.col("line").rlike("^#{2,3} "), "heading").when(F.col("line").startswith("- "), "list").otherwise("paragraph")
    w = Window.partitionBy("query_id").orderBy("pos")  # one answer's lines
    s = s.withColumn("kind", kind).withColumn("_new", F.when((F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.lag("kind").over(w)), 1).otherwise(0))
    s = s.withColumn("_g", F.sum("_new").over(w)).where("kind <> 'blank'")
    text = F.when(F.col("kind") == "heading", F.regexp_replace("line", "^#{2,3} ", "")).when(F.col("kind") == "list", F.substring("line", 3, 1_000_000)).otherwise(F.col("line"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"])
    g = s.groupBy("query_id", "_g", "kind").agg(F.array_join(parts, " ").alias("text"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("_g"))
    return g.select("query_id", n.cast("long").alias("block_no"), "kind", "text")
