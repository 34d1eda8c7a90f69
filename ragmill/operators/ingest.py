"""Ingest of whole documents: blocks to chunks, scores, vectors, outline, highlights and duplicate flags."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.functions.text import count_words, file_type
from ragmill.operators import answers, chunking, importance, vectors
from ragmill.session import written

#: Fixed value: the message of a document without text.
NO_TEXT = "No extractable text found in the document."


def ingest(docs: DataFrame, stored: DataFrame | None = None, strategy: str = "semantic", embedder: Callable[[pd.Series], pd.Series] = vectors.embed_array) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of a batch. docs: document_id, user_id, created_at, blocks, and filename,
    file_type (else that of the name) and storage_key if known; stored: centroids (user_id,
    document_id, created_at, dim, centroid) of documents that are there already.

    Chunks are whole sentences packed to a size, or character windows with strategy "character". A document that gives no
    chunk is a failed row with a message and has no other result; a duplicate is flagged, not dropped. Chunks are written
    once, as every later step reads them; each step after that shuffles by document."""
    cut = {"semantic": chunking.chunk_semantic, "character": chunking.chunk_blocks}[strategy]
    scored = importance.chunk_importance(written(cut(docs, ["document_id"]), "ingest-chunks"))
    chunks = written(vectors.hash_embed(scored, embedder=embedder).withColumn("retrieved_count", F.lit(0).cast("long")), "ingest-scored")

    entries = importance.outline(docs, chunks, blocks="blocks").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "heading", "level", "chunk_index"))).alias("o"))
    entry = lambda x: F.struct(x["heading"].alias("text"), x["level"].alias("level"), x["chunk_index"].alias("chunk_index"))
    outline = entries.select("document_id", F.to_json(F.transform("o", entry)).alias("outline_json"))

    best = written(importance.highlights(chunks), "ingest-highlights")
    light = lambda x: F.struct(x["text"].alias("text"), x["chunk_index"].alias("chunk_index"), x["score"].alias("score"))
    lights = best.groupBy("document_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text", "chunk_index", "score"))), light)).alias("highlights_json"))
    summary = answers.highlight_inputs(best).select("document_id", "summary_input")

    centroids = docs.select("document_id", "user_id", "created_at").join(vectors.doc_centroid(chunks), "document_id")
    same = vectors.near_duplicates(centroids)
    if stored is not None:  # what was there before comes first
        old = vectors.duplicates_of_new(centroids, stored)
        same = old.unionByName(same.join(old, "document_id", "left_anti"))
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))

    text = chunking.blocks_to_text(F.col("blocks"))
    given = lambda name: F.col(name) if name in docs.columns else F.lit(None).cast("string")
    files = [given("filename").alias("filename"), F.coalesce(given("file_type"), file_type(given("filename"))).alias("file_type"), given("storage_key").alias("storage_key")]
    out = docs.select("document_id", "user_id", "created_at", *files, F.nullif(chunking.page_count(F.col("blocks")), F.lit(0)).alias("page_count"), count_words(text).alias("word_count"))
    for part in (counts, outline, lights, summary, same.select("document_id", "duplicate_of")):
        out = out.join(part, "document_id", "left")
    done = F.col("chunks").isNotNull()
    out = out.select(
        "document_id", "user_id", "created_at", "filename", "file_type", "storage_key", F.lit(1).alias("version_number"), *[F.when(done, F.col(c)).alias(c) for c in ("page_count", "word_count")], F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.when(done, F.coalesce("outline_json", F.lit("[]"))).alias("outline_json"), "highlights_json", "summary_input", "duplicate_of",
        F.lit(strategy).alias("chunking_strategy"), F.when(done, "done").otherwise("failed").alias("processing_status"), F.when(~done, NO_TEXT).alias("processing_error"),
    )
    return out, chunks
