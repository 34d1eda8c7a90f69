"""Queries over the library: joins, lists, pages, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragmill.operators import library as lib
from ragmill.plans.registry import query
from ragmill.plans.text_queries import CHUNKS_SQL, chunks
from ragmill.sources.views import DOCS_SQL, LOG_SQL, documents, query_log, table

NOW = "2024-02-15 00:00:00"
TAGS_SQL = "tags AS (SELECT doc_id AS document_id, 'quality-' || quality AS tag FROM labels UNION ALL SELECT doc_id, 'toxic-' || toxic FROM labels)"
LIMITS = {"view": (20, "minute"), "click": (10, "hour"), "purchase": (5, "minute"), "signup": (3, "minute"), "error": (1, "hour")}
_IN = lambda q, cols: f"SELECT {cols} FROM ({q}) AS q"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    one = lambda c: lab.select(F.col("doc_id").alias("document_id"), F.concat(F.lit(f"{c}-"), F.col(c).cast("string")).alias("tag"))
    return one("quality").unionByName(one("toxic"))


@query("doc_filter", f"WITH {DOCS_SQL}, {TAGS_SQL} SELECT document_id, filename FROM docs WHERE deleted_at IS NULL AND processing_status <> 'failed' AND filename ILIKE '%doc_1%' AND document_id IN (SELECT document_id FROM tags WHERE tag = 'quality-1')")
def doc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tags(spark, sf_dir).where("tag = 'quality-1'").select("document_id")
    return lib.doc_filter(documents(spark, sf_dir), name="doc_1", tagged=tagged).select("document_id", "filename")


@query("tag_semi", f"WITH {DOCS_SQL}, {TAGS_SQL} SELECT document_id FROM docs WHERE document_id IN (SELECT document_id FROM tags WHERE tag = 'toxic-1')")
def tag_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(tags(spark, sf_dir).where("tag = 'toxic-1'"), "document_id", "left_semi").select("document_id")


@query("collection_semi", f"WITH {DOCS_SQL} SELECT document_id FROM docs WHERE lang IN ('de', 'fr') AND deleted_at IS NULL AND processing_status <> 'failed'")
def collection_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    members = d.where(F.col("lang").isin("de", "fr")).select("document_id")
    return lib.doc_filter(d, tagged=members).select("document_id")


@query("chunk_document", f"WITH {CHUNKS_SQL} SELECT document_id, chunk_index, filename FROM chunks WHERE deleted_at IS NULL")
def chunk_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"))
    d = documents(spark, sf_dir).where(F.col("deleted_at").isNull()).select("document_id", "filename")
    return c.join(d, "document_id")


@query("doc_chunk_counts", f"WITH {CHUNKS_SQL}, k AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) SELECT d.document_id, coalesce(n, 0) AS chunk_count FROM docs AS d LEFT JOIN k ON k.document_id = d.document_id")
def doc_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lib.doc_chunk_counts(documents(spark, sf_dir), chunks(spark, sf_dir)).select("document_id", "chunk_count")


@query("doc_tags", f"WITH {DOCS_SQL}, {TAGS_SQL}, t AS (SELECT document_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT document_id, tag FROM tags) AS q GROUP BY 1) SELECT d.document_id, coalesce(t.tags, '') AS tags FROM docs AS d LEFT JOIN t ON t.document_id = d.document_id")
def doc_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lib.doc_tags(documents(spark, sf_dir), tags(spark, sf_dir)).select("document_id", "tags")


RAW_TAGS_SQL = "raw AS (SELECT conv_id AS document_id, turn AS nth, lower(trim(' ' || upper(substr(role, 1, 4)) || CASE WHEN turn % 3 = 0 THEN '_' ELSE '-' END || turn || ' ')) AS tag FROM conversations)"


@query("tag_normalise", f"WITH {RAW_TAGS_SQL}, w AS (SELECT *, regexp_full_match(tag, '[a-z0-9-]+') AS well_formed FROM raw) SELECT document_id, nth, tag, well_formed, well_formed AND row_number() OVER (PARTITION BY document_id, well_formed ORDER BY nth) <= 2 AS accepted FROM w")
def tag_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    raw = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("nth"), F.concat(F.lit(" "), F.upper(F.substring("role", 1, 4)), F.when(F.col("turn") % 3 == 0, "_").otherwise("-"), F.col("turn").cast("string"), F.lit(" ")).alias("tag"))
    return lib.tag_normalise(raw, limit=2).select("document_id", "nth", "tag", "well_formed", "accepted")


@query("retag", f"WITH {TAGS_SQL} SELECT document_id, tag FROM tags WHERE NOT (tag = 'quality-0' AND document_id % 2 = 0)")
def retag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tags(spark, sf_dir)
    return lib.retag(t, t.where("tag = 'quality-0' AND document_id % 2 = 0"))


@query("duplicate_names", f"WITH {DOCS_SQL}, f AS (SELECT text AS t, min(document_id) AS o FROM docs GROUP BY 1), x AS (SELECT d.document_id, CASE WHEN f.o < d.document_id THEN f.o END AS duplicate_of FROM docs AS d JOIN f ON f.t = d.text) SELECT x.document_id, x.duplicate_of, o.filename AS duplicate_name FROM x LEFT JOIN docs AS o ON o.document_id = x.duplicate_of")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    h = d.select("document_id", F.sha2("text", 256).alias("_h"))
    first = h.groupBy("_h").agg(F.min("document_id").alias("duplicate_of"))
    dup = h.join(first, "_h").where("duplicate_of < document_id")
    return lib.duplicate_names(d, dup).select("document_id", "duplicate_of", "duplicate_name")


@query("collection_counts", f"WITH {DOCS_SQL} SELECT lang AS collection_id, count(*) AS documents FROM docs WHERE lang <> 'es' GROUP BY 1")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    cols = d.select(F.col("lang").alias("collection_id")).distinct().withColumn("deleted_at", F.when(F.col("collection_id") == "es", F.lit(NOW)))
    return lib.collection_counts(cols, d.select(F.col("lang").alias("collection_id"), "document_id"))


@query("collection_documents", f"WITH {CHUNKS_SQL}, k AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1) SELECT lang AS collection_id, d.document_id, coalesce(n, 0) AS chunk_count FROM docs AS d LEFT JOIN k ON k.document_id = d.document_id WHERE deleted_at IS NULL")
def collection_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    members = d.select("document_id", F.col("lang").alias("collection_id"))
    return lib.collection_documents(members, d, chunks(spark, sf_dir)).select("collection_id", "document_id", "chunk_count")


@query("list_documents", f"""WITH {CHUNKS_SQL}, {TAGS_SQL}, k AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1), t AS (SELECT document_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT document_id, tag FROM tags) AS q GROUP BY 1),
  r AS (SELECT document_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, document_id DESC) AS rank, count(*) OVER (PARTITION BY user_id) AS total FROM docs WHERE deleted_at IS NULL AND processing_status <> 'failed'),
  dup AS (SELECT a.document_id, min(b.document_id) AS duplicate_of FROM docs AS a JOIN docs AS b ON b.user_id = a.user_id AND b.text = a.text AND b.document_id < a.document_id GROUP BY 1)
  SELECT r.user_id, r.document_id, rank, total, coalesce(n, 0) AS chunk_count, coalesce(tags, '') AS tags, 'doc_' || duplicate_of || '.txt' AS duplicate_name FROM r LEFT JOIN dup ON dup.document_id = r.document_id LEFT JOIN k ON k.document_id = r.document_id LEFT JOIN t ON t.document_id = r.document_id WHERE rank <= 50""")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of every user, with the name of the earliest document of the same text."""
    d = documents(spark, sf_dir)
    first = Window.partitionBy("user_id", F.md5("text"))
    same = d.select("document_id", F.min("document_id").over(first).alias("duplicate_of")).where("duplicate_of < document_id")
    page = lib.page(lib.doc_filter(d), "user_id", 50, id_col="document_id")
    page = lib.doc_tags(lib.doc_chunk_counts(page, chunks(spark, sf_dir)), tags(spark, sf_dir)).join(same, "document_id", "left")
    names = d.select(F.col("document_id").alias("duplicate_of"), F.col("filename").alias("duplicate_name"))
    return page.join(names, "duplicate_of", "left").select("user_id", "document_id", "rank", "total", "chunk_count", "tags", "duplicate_name")


_PAGE = "SELECT user_id, id, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank, count(*) OVER (PARTITION BY user_id) AS total FROM qlog WHERE {}) AS q WHERE rank > {} AND rank <= {}"


@query("page_history", f"WITH {LOG_SQL} " + _PAGE.format("deleted_at IS NULL", 20, 40))
def page_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lib.page(query_log(spark, sf_dir).where("deleted_at IS NULL"), "user_id", 20, 20).select("user_id", "id", "rank", "total")


@query("chat_history_page", f"WITH {LOG_SQL} " + _PAGE.format("true", 0, 20))
def chat_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lib.page(query_log(spark, sf_dir), "user_id", 20).select("user_id", "id", "rank", "total")


@query("bookmarks", f"WITH {LOG_SQL} SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM qlog WHERE deleted_at IS NULL AND bookmarked")
def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lib.page(query_log(spark, sf_dir).where("deleted_at IS NULL AND bookmarked"), "user_id", 2**31 - 1).select("user_id", "id", "rank")


@query("history_last6", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS o FROM conversations) AS q WHERE o <= 6")
def history_last6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lib.last_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


@query("append_version", "SELECT user_id, event_id, CAST(row_number() OVER w AS BIGINT) AS version_number, lag('k' || event_id) OVER w AS archived_key FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, 'k' || event_id)")
def append_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("filename"), F.col("ts").alias("uploaded_at"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("storage_key"))
    return lib.append_version(e).select("user_id", "event_id", F.col("version_number").cast("long").alias("version_number"), "archived_key")


@query("version_history", "SELECT user_id, event_type AS filename, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS position FROM events")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("filename"), F.col("ts").alias("created_at"))
    e = e.withColumn("_g", F.struct("user_id", "filename"))
    return lib.page(e, "_g", 2**31 - 1, id_col="event_id").select("user_id", "filename", "event_id", F.col("rank").alias("position"))


@query("restorable", f"WITH {DOCS_SQL} SELECT document_id, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(deleted_at)) / 86400) AS BIGINT) AS days, floor((epoch(TIMESTAMP '{NOW}') - epoch(deleted_at)) / 86400) < 30 AS restorable FROM docs WHERE deleted_at IS NOT NULL")
def restorable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lib.restorable(documents(spark, sf_dir), NOW).select("document_id", "days", "restorable")


@query("trash", f"WITH {DOCS_SQL} SELECT user_id, document_id, row_number() OVER (PARTITION BY user_id ORDER BY deleted_at DESC, document_id DESC) AS position FROM docs WHERE deleted_at IS NOT NULL")
def trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).where("deleted_at IS NOT NULL").withColumn("created_at", F.col("deleted_at"))
    return lib.page(d, "user_id", 2**31 - 1, id_col="document_id").select("user_id", "document_id", F.col("rank").alias("position"))


def stored_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The library's tables, made of documents, labels, events and conversations: every link of the cascade has rows."""
    d = documents(spark, sf_dir).withColumn("storage_key", F.concat("user_id", F.lit("/"), "filename"))
    c = chunks(spark, sf_dir).select("document_id", F.col("id").alias("chunk_id"))
    seen = table(spark, sf_dir, "events").select((F.get_json_object("props", "$.k").cast("long") * 100_000).alias("chunk_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("user_id"))
    log = query_log(spark, sf_dir).withColumn("user_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")))
    langs = d.select("lang").distinct()
    return {
        "users": d.select("user_id").distinct(), "documents": d.select("document_id", "user_id", "storage_key", "deleted_at"),
        "collections": langs.select(F.col("lang").alias("collection_id"), F.lit("src3").alias("user_id"), F.when(F.col("lang") == "fr", F.lit("2024-01-02").cast("timestamp")).alias("deleted_at")),
        "chat_history": log.select("id", "user_id", "deleted_at"), "chunks": c, "chunk_coverage": seen.distinct(), "document_tags": tags(spark, sf_dir),
        "collection_documents": d.select("document_id", F.col("lang").alias("collection_id")),
        "document_versions": d.where("document_id % 3 = 0").select("document_id", F.concat(F.lit("old/"), "filename").alias("storage_key")),
        "document_timelines": d.where("document_id % 5 = 0").select("document_id"),
    }


_STORED = CHUNKS_SQL + f""", {TAGS_SQL}, {LOG_SQL},
  cov AS (SELECT DISTINCT k * 100000 AS chunk_id, 'src' || (user_id % 20) AS user_id FROM qlog),
  col AS (SELECT DISTINCT lang AS collection_id, 'src3' AS user_id, lang = 'fr' AS old FROM documents)"""
_GONE = """ SELECT 'users' AS "table", {u} AS "rows" UNION ALL SELECT 'documents', (SELECT count(*) FROM gd) UNION ALL SELECT 'collections', (SELECT count(*) FROM gc)
  UNION ALL SELECT 'chat_history', (SELECT count(*) FROM qlog WHERE {h}) UNION ALL SELECT 'chunks', (SELECT count(*) FROM chunks WHERE document_id IN (FROM gd))
  UNION ALL SELECT 'chunk_coverage', (SELECT count(*) FROM cov WHERE {v} OR chunk_id IN (SELECT id FROM chunks WHERE document_id IN (FROM gd)))
  UNION ALL SELECT 'document_tags', (SELECT count(*) FROM tags WHERE document_id IN (FROM gd)) UNION ALL SELECT 'collection_documents', (SELECT count(*) FROM docs WHERE document_id IN (FROM gd) OR lang IN (FROM gc))
  UNION ALL SELECT 'document_versions', (SELECT count(*) FROM docs WHERE document_id % 3 = 0 AND document_id IN (FROM gd)) UNION ALL SELECT 'document_timelines', (SELECT count(*) FROM docs WHERE document_id % 5 = 0 AND document_id IN (FROM gd))"""


@query("purge_deleted", f"WITH {_STORED}, gd AS (SELECT document_id FROM docs WHERE deleted_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY), gc AS (SELECT collection_id FROM col WHERE old)" + _GONE.format(u="0", h=f"deleted_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY", v="false"))
def purge_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lib.purge_deleted(stored_tables(spark, sf_dir), NOW)[1]


@query("purge_user", f"WITH {_STORED}, gd AS (SELECT document_id FROM docs WHERE user_id = 'src3'), gc AS (SELECT collection_id FROM col)" + _GONE.format(u="(SELECT count(DISTINCT user_id) FROM docs WHERE user_id = 'src3')", h="user_id % 20 = 3", v="user_id = 'src3'"))
def purge_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = stored_tables(spark, sf_dir)
    return lib.purge_users(tables, tables["users"].where("user_id = 'src3'"))[1]


@query("purge_files", f"WITH {DOCS_SQL}, gd AS (SELECT * FROM docs WHERE deleted_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY) SELECT user_id || '/' || filename AS storage_key FROM gd UNION ALL SELECT 'old/' || filename FROM gd WHERE document_id % 3 = 0")
def purge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lib.purge_deleted(stored_tables(spark, sf_dir), NOW)[2]


@query("usable_reset_tokens", "SELECT event_id FROM events WHERE event_type <> 'purchase' AND ts + INTERVAL 7 DAY >= TIMESTAMP '2024-01-20 00:00:00'")
def usable_reset_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", (F.col("ts") + F.expr("INTERVAL 7 DAY")).alias("expires_at"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("used_at"))
    return lib.usable_reset_tokens(e, "2024-01-20 00:00:00").select("event_id")


@query("expired_tokens", "SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY < TIMESTAMP '2024-01-20 00:00:00'")
def expired_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 7 DAY")).alias("expires_at"))
    return lib.expired_tokens(e, "2024-01-20 00:00:00").select("event_id")


@query("token_reuse", """WITH u AS (SELECT event_id, user_id, event_id // 3 AS jti, ts - INTERVAL 1 HOUR AS issued_at, ts AS used_at FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, jti ORDER BY used_at, issued_at) > 1 AS reused FROM u), b AS (SELECT user_id, max(used_at) AS rb FROM r WHERE reused GROUP BY 1)
  SELECT event_id, reused, coalesce(issued_at < rb, false) AS revoked FROM r LEFT JOIN b ON b.user_id = r.user_id""")
def token_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 3).alias("jti"), (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("issued_at"), F.col("ts").alias("used_at"))
    return lib.token_reuse(e).select("event_id", "reused", "revoked")


_CASES = " ".join(f"WHEN '{a}' THEN date_trunc('{u}', ts)" for a, (_, u) in LIMITS.items())
_MOST = " ".join(f"WHEN '{a}' THEN {n}" for a, (n, _) in LIMITS.items())


@query("rate_limit_audit", f"WITH w AS (SELECT event_id, user_id, event_type, ts, CASE event_type {_CASES} END AS ws FROM events) SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, ws ORDER BY ts, event_id) AS nth, coalesce(row_number() OVER (PARTITION BY user_id, event_type, ws ORDER BY ts, event_id) > CASE event_type {_MOST} END, false) AS limited FROM w")
def rate_limit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("action"), "ts")
    return lib.rate_limit_audit(e, LIMITS).select(F.col("id").alias("event_id"), "nth", "limited")


@query("progress_changes", """WITH s AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE event_type END AS state FROM events),
  w AS (SELECT *, lag(state) OVER o AS before, coalesce(sum(CASE WHEN state IN ('done', 'failed') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM s WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT event_id, state FROM w WHERE d = 0 AND state IS DISTINCT FROM before""")
def progress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts", state.alias("state"))
    return lib.progress_changes(e).select(F.col("id").alias("event_id"), "state")


@query("scope_intersect", f"WITH {DOCS_SQL} SELECT document_id FROM docs WHERE lang = 'en' INTERSECT SELECT document_id FROM docs WHERE user_id IN ('src1', 'src2')")
def scope_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.where("lang = 'en'").select("document_id").intersect(d.where("user_id IN ('src1', 'src2')").select("document_id"))


@query("backfill_storage_key", "SELECT page_id, 'legacy://' || url AS storage_key, url AS restored FROM pages")
def backfill_storage_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", lib.add_key_scheme(F.col("url")).alias("storage_key"))
    return p.withColumn("restored", lib.drop_key_scheme(F.col("storage_key")))


@query("export_missing_files", f"WITH {DOCS_SQL} SELECT document_id FROM docs WHERE document_id NOT IN (SELECT page_id FROM pages)")
def export_missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("document_id"))
    return documents(spark, sf_dir).join(files, "document_id", "left_anti").select("document_id")
