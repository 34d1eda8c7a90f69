"""Registered queries of the training-data operators: each reads its whole tables, applies an operator with production
parameters and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm import bpe, decontam, jaccard, licenses, merkle, mixing, pu, quality, quotes, suffix_tree, token_counts, warc, whitening
from ragmill.llm.common import materialize

WORD_BPE = "word_bpe_49k.json"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_t(spark, sf_dir, "documents"))


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_conversations(_t(spark, sf_dir, "conversations"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_t(spark, sf_dir, "documents")).withColumn("n_detections", F.size("detections").cast("long")).drop("detections")


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.lm_scores(_t(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_t(spark, sf_dir, "documents"), WORD_BPE, digests=True)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_t(spark, sf_dir, "documents"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(_t(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.pu_scores(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op10_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = bpe.encoded_lengths(_t(spark, sf_dir, "documents"), WORD_BPE)
    hist = materialize(token_counts.length_histogram(lengths), "length-histogram")  # else each reader encodes again
    return token_counts.with_suffix_sums(hist)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_t(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_t(spark, sf_dir, "embeddings"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_t(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quote_links": op2_quote_links,
    "op3_license_scan": op3_license_scan,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc_round_trip": op8_warc_round_trip,
    "op9_pu_quality": op9_pu_quality,
    "op10_length_histogram": op10_length_histogram,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_source_mixing": op13_source_mixing,
}

ORACLES: dict[str, str] = {
    # the CRC-32 of the id's digits bit by bit, the trees level by level, each leaf's siblings folded in a list
    "op11_merkle_manifest": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, text,
               concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                 coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
               list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: ascii(z)::UBIGINT),
                 lambda a, z: list_reduce(range(8), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END, xor(a, z)), 4294967295::UBIGINT) % 2 = 1 AS hit
             FROM documents),
        e AS (SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               CASE WHEN hit THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered FROM d),
        o AS (SELECT *, coalesce('s' || source, '') AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM e),
        u AS (SELECT 0 AS l, t, i, leaf AS h, c FROM o
              UNION ALL SELECT l + 1, t, i // 3, sha256(string_agg(h, '' ORDER BY i)), (c + 2) // 3 FROM u WHERE c > 1 GROUP BY l, t, i // 3, c),
        s AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS c FROM u WHERE c = 1),
        v AS (SELECT 0 AS l, i, h, c FROM s
              UNION ALL SELECT l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (c + 2) // 3 FROM v WHERE c > 1 GROUP BY l, i // 3, c),
        a AS (SELECT l, t, i, h, c FROM u UNION ALL SELECT l, NULL, i, h, c FROM v),
        n AS (SELECT x.l, x.t, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS lf, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS rt
              FROM a AS x JOIN a AS y ON x.l = y.l AND x.t IS NOT DISTINCT FROM y.t AND x.i // 3 = y.i // 3 WHERE x.c > 1 GROUP BY x.l, x.t, x.i),
        p AS (SELECT o.r, n.l, lf, rt FROM o JOIN n ON n.t = o.t AND n.i = o.i // CAST(pow(3, n.l) AS BIGINT)
              UNION ALL SELECT o.r, 100 + n.l, lf, rt FROM o JOIN s ON s.t = o.t JOIN n ON n.t IS NULL AND n.i = s.i // CAST(pow(3, n.l) AS BIGINT)),
        q AS (SELECT r, sha256(string_agg(lf || rt, '' ORDER BY l)) AS proof, list(lf || '|' || rt ORDER BY l) AS steps FROM p GROUP BY r),
        z AS (SELECT doc_id, o.source, leaf, s.h AS subroot, (SELECT h FROM v WHERE c = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
                list_reduce(coalesce(steps, []), lambda b, k: sha256(split_part(k, '|', 1) || b || split_part(k, '|', 2)), coalesce(tampered, leaf)) AS folded_root
              FROM o JOIN s ON s.t = o.t LEFT JOIN q ON q.r = o.r)
        SELECT *, folded_root = root AS verified FROM z""",
    "op6_decontamination": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS t
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) AS q),
        ns AS (SELECT DISTINCT n FROM bw),
        tok AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
        df AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
        bt AS (SELECT item_id, g, words, unnest(words) AS t, unnest(range(len(words))) AS o FROM (SELECT item_id, t AS g, string_split(t, ' ') AS words FROM bw) AS q),
        anchor AS (SELECT item_id, words, arg_min(bt.t, {'c': coalesce(c, 0), 'o': o}) AS t FROM bt LEFT JOIN df ON bt.t = df.t GROUP BY item_id, words),
        near AS (SELECT r, count(DISTINCT item_id) AS n_near FROM (
                 SELECT tok.r, item_id FROM anchor JOIN tok ON tok.t = anchor.t JOIN d ON d.r = tok.r WHERE list_has_all(d.w[greatest(p - 20, 1):p + 20], words)) AS q GROUP BY r),
        dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
               FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n) AS q),
        m AS (SELECT r, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) AS q GROUP BY r),
        s AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM m) AS q GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(n_near, 0) AS n_near, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN s ON d.r = s.r LEFT JOIN near ON d.r = near.r""",
    "op8_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        g AS (SELECT payload_digest AS k, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to,
               true AS digest_ok
        FROM d LEFT JOIN g ON payload_digest = k AND payload_bytes >= 1000""",
}
