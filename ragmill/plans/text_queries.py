"""Queries over texts: scalar rules, blocks, chunks, importance and outline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.functions import text as tx
from ragmill.operators import chunking, importance
from ragmill.plans.registry import query
from ragmill.sources.views import DOCS_SQL, documents, table

_ABBR = "|".join(tx.ABBREVIATIONS)
_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_MARK = f"(?i)(^|[^\\p{{L}}\\p{{N}}_])((?:{_ABBR})\\.)\\s+"
SENTS = f"string_split(replace(regexp_replace(regexp_replace(regexp_replace(trim(T), '{_MARK}', '\\1\\2' || chr(2), 'g'), '{_MARK}', '\\1\\2' || chr(2), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(2), ' '), chr(1))"
STRIP = "regexp_replace(T, '^\\s+|\\s+$', '', 'g')"
CHUNKS_SQL = DOCS_SQL + """, chunks AS (SELECT document_id, user_id, filename, deleted_at, document_id * 100000 + row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS id,
    row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS chunk_index, content
    FROM (SELECT document_id, user_id, filename, deleted_at, s, regexp_replace(substr(t, s + 1, 800), '^\\s+|\\s+$', '', 'g') AS content
      FROM (SELECT document_id, user_id, filename, deleted_at, t, unnest(range(0, greatest(length(t) - 151, 0) + 1, 650)) AS s
        FROM (SELECT document_id, user_id, filename, deleted_at, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM docs) AS a WHERE length(t) > 0) AS b) AS c
    WHERE content <> '')"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character chunks of all documents with ids that sort in corpus order."""
    c = chunking.chunk_text(documents(spark, sf_dir), ["document_id", "user_id", "filename", "deleted_at"])
    return c.withColumn("id", F.col("document_id") * 100_000 + F.col("chunk_index"))


@query("count_words", f"WITH {DOCS_SQL} SELECT document_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words FROM docs")
def count_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("document_id", tx.count_words(F.col("text")).alias("words"))


@query("clean_text", "SELECT conv_id, turn, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS text FROM conversations")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean_text(F.col("text")).alias("text"))


@query("bm25_tokens", f"WITH {DOCS_SQL} SELECT document_id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, ' ')) AS digest FROM (SELECT document_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM docs) AS q")
def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.bm25_tokens(F.col("text"))
    return documents(spark, sf_dir).select("document_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


@query("content_tokens", f"""WITH {DOCS_SQL}, t AS (SELECT document_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]*'))) AS w FROM docs)
    SELECT document_id, count(*) AS n, count(DISTINCT w) AS n_distinct FROM t WHERE length(w) > 1 AND w NOT IN ({_STOP}) GROUP BY 1""")
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("document_id", tx.content_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return d.select("document_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("split_sentences", f"""WITH {DOCS_SQL}, s AS (SELECT document_id, {SENTS.replace("trim(T)", STRIP.replace("T", "text", 1))} AS x FROM docs)
    SELECT document_id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, '|')) AS digest FROM s WHERE x[1] <> ''""")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("document_id", tx.split_sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return d.select("document_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


HEADING = """CASE WHEN s <> '' AND length(s) <= 80 AND length(regexp_replace(s, '\\P{L}', '', 'g')) >= 2 AND len(regexp_extract_all(s, '\\S+')) <= 12
    AND (upper(s) = s OR (regexp_matches(s, '^\\p{Lu}') AND NOT regexp_matches(s, '[.,;:!?]$') AND len(regexp_extract_all(s, '\\S+')) <= 8)) THEN s END"""
LINES_SQL = DOCS_SQL + f""", lines AS (SELECT document_id, pos, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s
    FROM (SELECT document_id, unnest(range(0, len(x))) AS pos, unnest(x) AS line FROM (SELECT document_id, string_split(text, chr(10)) AS x FROM docs) AS q) AS q2),
    heads AS (SELECT document_id, pos, {HEADING} AS heading FROM lines)"""


@query("detect_headings", f"WITH {LINES_SQL} SELECT document_id, pos, heading FROM heads WHERE heading IS NOT NULL")
def detect_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir).select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("document_id", F.col("pos").cast("long").alias("pos"), tx.detect_heading(F.col("line")).alias("heading")).where(F.col("heading").isNotNull())


_SNIP = "replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ')"


@query("snippet", f"""WITH {DOCS_SQL}, s AS (SELECT document_id, {_SNIP} AS t FROM docs), c AS (SELECT document_id, t, substr(t, 1, 240) AS u FROM s)
    SELECT document_id, CASE WHEN length(t) > 240 THEN CASE WHEN contains(u, ' ') THEN regexp_replace(u, ' [^ ]*$', '') ELSE u END || '…' ELSE t END AS snippet FROM c""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("document_id", tx.snippet(F.col("text")).alias("snippet"))


@query("cache_key", "SELECT conv_id, turn, 'qcache:' || conv_id || ':' || role || ':' || sha256(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')) AS cache_key FROM conversations")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.cache_key(F.col("conv_id"), F.col("text"), F.col("role")).alias("cache_key"))


@query("file_type", "SELECT page_id, CASE WHEN contains(url, '.') THEN lower(string_split(url, '.')[len(string_split(url, '.'))]) ELSE '' END AS file_type FROM pages")
def file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.file_type(F.col("url")).alias("file_type"))


@query("confidence_band", "SELECT event_id, CASE WHEN value / 500 > 0.7 THEN 'High' WHEN value / 500 >= 0.4 THEN 'Moderate' ELSE 'Low' END AS band FROM events")
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.confidence_band(F.col("value") / 500).alias("band"))


@query("table_rows_text", "SELECT c_custkey, concat_ws(', ', 'c_custkey: ' || c_custkey, CASE WHEN c_name <> '' THEN 'c_name: ' || c_name END, 'c_nationkey: ' || c_nationkey) AS row_text FROM customer")
def table_rows_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", tx.row_text(["c_custkey", "c_name", "c_nationkey"]).alias("row_text"))


@query("chunk_text", f"WITH {CHUNKS_SQL} SELECT document_id, chunk_index, length(content) AS chars, md5(content) AS digest FROM chunks")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"))


@query("blocks_to_text", f"WITH {LINES_SQL} SELECT document_id, md5(string_agg(line, chr(10) || chr(10) ORDER BY pos)) AS digest, CAST(max(1 + pos // 5) AS BIGINT) AS pages FROM lines WHERE line <> '' GROUP BY 1")
def blocks_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("b", F.filter(chunking.line_blocks(F.col("text")), lambda b: b["text"] != "")).where(F.size("b") > 0)
    return d.select("document_id", F.md5(chunking.blocks_to_text(F.col("b"))).alias("digest"), chunking.page_count(F.col("b")).cast("long").alias("pages"))


BLOCK_CHUNKS_SQL = LINES_SQL + """, b AS (SELECT l.document_id, l.pos, l.s AS t, 1 + l.pos // 5 AS page, h.heading,
      sum(length(l.s) + 2) OVER (PARTITION BY l.document_id ORDER BY l.pos) - length(l.s) - 2 AS at,
      max(CASE WHEN h.heading IS NOT NULL THEN l.pos END) OVER (PARTITION BY l.document_id ORDER BY l.pos) AS hp
    FROM lines AS l JOIN heads AS h ON l.document_id = h.document_id AND l.pos = h.pos WHERE l.s <> ''),
  f AS (SELECT document_id, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS t FROM b GROUP BY 1),
  w AS (SELECT document_id, s, regexp_replace(substr(t, s + 1, 800), '^\\s+|\\s+$', '', 'g') AS content
    FROM (SELECT document_id, t, unnest(range(0, greatest(length(t) - 151, 0) + 1, 650)) AS s FROM f) AS q),
  a AS (SELECT w.document_id, w.s, w.content, max(b.pos) AS pos FROM w JOIN b ON w.document_id = b.document_id AND b.at <= w.s WHERE content <> '' GROUP BY 1, 2, 3)"""


@query("chunk_blocks", f"""WITH {BLOCK_CHUNKS_SQL} SELECT a.document_id, row_number() OVER (PARTITION BY a.document_id ORDER BY a.s) - 1 AS chunk_index, md5(a.content) AS digest, CAST(b.page AS INTEGER) AS page_number, h.heading AS section_heading
    FROM a JOIN b ON a.document_id = b.document_id AND a.pos = b.pos LEFT JOIN heads AS h ON h.document_id = b.document_id AND h.pos = b.hp""")
def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("blocks", chunking.line_blocks(F.col("text")))
    c = chunking.chunk_blocks(d, ["document_id"])
    return c.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("digest"), "page_number", "section_heading")


SEMANTIC_SQL = (
    BLOCK_CHUNKS_SQL.split(",\n  f AS")[0]
    + """, xs AS (SELECT document_id, pos, page, hp, unnest(x) AS t, unnest(range(len(x))) AS k FROM (SELECT document_id, pos, page, hp, """ + SENTS.replace("trim(T)", "t", 1) + """ AS x FROM b) AS q),
  sn AS (SELECT xs.document_id, row_number() OVER (PARTITION BY xs.document_id ORDER BY xs.pos, k) - 1 AS i, t, page, heading,
      sum(length(t) + 1) OVER (PARTITION BY xs.document_id ORDER BY xs.pos, k) AS upto, count(*) OVER (PARTITION BY xs.document_id) AS n
    FROM xs LEFT JOIN heads AS h ON h.document_id = xs.document_id AND h.pos = xs.hp),
  en AS (SELECT x.document_id, x.i AS a, x.n, greatest(x.i + 1, max(y.i) + 1) AS e FROM sn AS x JOIN sn AS y ON y.document_id = x.document_id AND y.i >= x.i
      AND (y.i = x.i OR y.upto - x.upto + length(x.t) <= 3200) GROUP BY x.document_id, x.i, x.n),
  pk AS (SELECT document_id, 0 AS chunk_index, a, e, n FROM en WHERE a = 0
    UNION ALL SELECT en.document_id, chunk_index + 1, en.a, en.e, en.n FROM pk JOIN en ON en.document_id = pk.document_id AND en.a = greatest(pk.a + 1, pk.e - 2) WHERE pk.e < pk.n)"""
)


@query("chunk_semantic", f"""WITH RECURSIVE {SEMANTIC_SQL} SELECT pk.document_id, chunk_index, md5(string_agg(sn.t, ' ' ORDER BY sn.i)) AS digest, min_by(sn.page, sn.i) AS page_number, first(sn.heading ORDER BY sn.i) AS section_heading
  FROM pk JOIN sn ON sn.document_id = pk.document_id AND sn.i >= pk.a AND sn.i < pk.e GROUP BY 1, 2""")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).withColumn("blocks", chunking.line_blocks(F.col("text")))
    c = chunking.chunk_semantic(d, ["document_id"])
    return c.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("content").alias("digest"), "page_number", "section_heading")


IMPORTANCE_SQL = CHUNKS_SQL + f""", tok AS (SELECT document_id, chunk_index, lower(unnest(regexp_extract_all(content, '[A-Za-z][A-Za-z0-9''-]*'))) AS term FROM chunks),
  tf AS (SELECT document_id, chunk_index, term, count(*) AS c FROM tok WHERE length(term) > 1 AND term NOT IN ({_STOP}) GROUP BY 1, 2, 3),
  dfr AS (SELECT document_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
  nn AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY 1),
  rw AS (SELECT tf.document_id, chunk_index, sum(c * (ln((n + 1) / (df + 1)) + 1)) / sum(c) AS raw FROM tf JOIN dfr ON tf.document_id = dfr.document_id AND tf.term = dfr.term JOIN nn ON nn.document_id = tf.document_id GROUP BY 1, 2),
  r1 AS (SELECT c.document_id, c.user_id, c.id, c.chunk_index, c.content, nn.n, round(coalesce(raw, 0), 10) AS raw FROM chunks AS c JOIN nn ON nn.document_id = c.document_id LEFT JOIN rw ON rw.document_id = c.document_id AND rw.chunk_index = c.chunk_index),
  r2 AS (SELECT *, CASE WHEN max(raw) OVER w - min(raw) OVER w < 1e-12 THEN 0.5 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS t,
      greatest(1, CAST(round_even(n * 0.05, 0) AS BIGINT)) AS edge FROM r1 WINDOW w AS (PARTITION BY document_id)),
  r3 AS (SELECT *, round(0.6 * t + 0.4 * CASE WHEN chunk_index < edge OR chunk_index >= n - edge THEN 0.5 ELSE 1.0 END, 10) AS b FROM r2),
  imp AS (SELECT document_id, user_id, id, chunk_index, content, round(CASE WHEN n = 1 THEN 1.0 WHEN max(b) OVER w - min(b) OVER w < 1e-12 THEN 0.5 ELSE (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) END, 9) AS importance_score FROM r3 WINDOW w AS (PARTITION BY document_id))"""


@query("chunk_importance", f"WITH {IMPORTANCE_SQL} SELECT document_id, chunk_index, round(importance_score, 6) AS importance_score FROM imp")
def chunk_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = importance.chunk_importance(chunks(spark, sf_dir))
    return i.select("document_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("importance_score", 6).alias("importance_score"))


HIGHLIGHTS_SQL = f"""{IMPORTANCE_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY importance_score DESC, chunk_index) AS rank FROM imp),
  s AS (SELECT document_id, rank, i, s FROM (SELECT document_id, rank, unnest(range(0, len(x))) AS i, unnest(x) AS s FROM (SELECT document_id, rank, string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS x FROM top WHERE rank <= 8) AS q) AS q2),
  sc AS (SELECT *, len(regexp_extract_all(s, '\\S+')) AS n, len(regexp_extract_all(' ' || regexp_replace(s, '\\s+', '  ', 'g'), '\\s\\p{{Lu}}')) AS caps FROM s),
  best AS (SELECT document_id, rank, s, row_number() OVER (PARTITION BY document_id, rank ORDER BY caps / n DESC, n DESC, i) AS o FROM sc),
  hl AS (SELECT t.document_id, t.rank, t.chunk_index, substr(b.s, 1, 280) AS text, round(t.importance_score, 4) AS score FROM top AS t JOIN best AS b ON b.document_id = t.document_id AND b.rank = t.rank WHERE o = 1)"""


@query("highlights", f"WITH {HIGHLIGHTS_SQL} SELECT * FROM hl")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = importance.highlights(importance.chunk_importance(chunks(spark, sf_dir)))
    return h.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("outline", f"""WITH {LINES_SQL}, {CHUNKS_SQL.split(", ", 1)[1] if False else CHUNKS_SQL[len(DOCS_SQL) + 2:]}, h AS (SELECT document_id, heading, pos, row_number() OVER (PARTITION BY document_id, lower(heading) ORDER BY pos) AS o FROM heads WHERE heading IS NOT NULL)
  SELECT h.document_id, substr(h.heading, 1, 500) AS heading, 1 AS level, coalesce(min(c.chunk_index), 0) AS chunk_index, h.pos AS line_no
  FROM h LEFT JOIN chunks AS c ON c.document_id = h.document_id AND contains(lower(c.content), lower(h.heading)) WHERE o = 1 GROUP BY h.document_id, h.heading, h.pos""")
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = importance.outline(documents(spark, sf_dir), chunks(spark, sf_dir))
    return o.select("document_id", "heading", "level", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("line_no").cast("long").alias("line_no"))


@query("outline_blocks", f"""WITH {LINES_SQL}, {CHUNKS_SQL[len(DOCS_SQL) + 2:]}, e AS (SELECT l.document_id, l.pos, CASE WHEN l.pos % 2 = 0 AND l.line <> '' THEN nullif(l.s, '') ELSE h.heading END AS heading,
      CASE WHEN l.pos % 2 = 0 AND l.line <> '' THEN least(greatest(l.pos % 7 - 1, 1), 3) ELSE 1 END AS level FROM lines AS l JOIN heads AS h ON h.document_id = l.document_id AND h.pos = l.pos),
  o AS (SELECT *, row_number() OVER (PARTITION BY document_id, lower(heading) ORDER BY pos) AS o FROM e WHERE heading IS NOT NULL)
  SELECT o.document_id, substr(heading, 1, 500) AS heading, level, coalesce(min(c.chunk_index), 0) AS chunk_index, pos AS line_no FROM o LEFT JOIN chunks AS c ON c.document_id = o.document_id AND contains(lower(c.content), lower(heading))
  WHERE o.o = 1 GROUP BY o.document_id, heading, level, pos""")
def outline_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other line is a heading block with a level from -1 to 5, the lines between are told by their looks."""
    block = lambda x, i: F.struct(x.alias("text"), F.lit(1).alias("page"), x.alias("heading"), (i % 7 - 1).alias("level"), (i % 2 == 0).alias("is_heading"))
    d = documents(spark, sf_dir).withColumn("blocks", F.transform(F.split("text", "\n", -1), block))
    o = importance.outline(d, chunks(spark, sf_dir), blocks="blocks")
    return o.select("document_id", "heading", "level", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("line_no").cast("long").alias("line_no"))
