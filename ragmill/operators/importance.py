"""Importance of chunks within their document, highlights and outline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import detect_heading, representative_sentence, strip
from ragmill.functions.tokens import tokens
from ragmill.session import ship

_LINE_ENDS = r"\R|[\x1C-\x1E]"


def minmax(value: Column, by: Window, constant: float) -> Column:
    """(v - lo) / (hi - lo) over a window; `constant` where all are equal."""
    lo, hi = F.min(value).over(by), F.max(value).over(by)
    return F.when(hi - lo < 1e-12, F.lit(constant)).otherwise((value - lo) / (hi - lo))


def document_scores(contents: list[str | None], places: np.ndarray, documents: np.ndarray, digits: int = 9) -> np.ndarray:
    """importance_score of the chunks of some whole documents, numbered from 0 in `documents`."""
    half = lambda x, d: np.floor(x * 10.0**d + 0.5) / 10.0**d
    found = tokens(contents, content=True)
    rows, codes, times = found.counts()
    n = np.bincount(documents)
    pairs, at = np.unique(documents[rows] * max(1, len(found.terms)) + codes, return_inverse=True)  # terms of a document
    idf = np.log((n[documents[rows]] + 1) / (np.bincount(at, minlength=len(pairs))[at] + 1)) + 1
    total = np.bincount(rows, times, len(contents))
    raw = half(np.divide(np.bincount(rows, times * idf, len(contents)), total, out=np.zeros(len(contents)), where=total > 0), 10)

    def scaled(x: np.ndarray) -> np.ndarray:
        lo, hi = np.full(len(n), np.inf), np.full(len(n), -np.inf)
        np.minimum.at(lo, documents, x)
        np.maximum.at(hi, documents, x)
        span = (hi - lo)[documents]
        return np.where(span < 1e-12, 0.5, (x - lo[documents]) / np.where(span < 1e-12, 1, span))

    edge, size = np.maximum(1, np.rint(n * 0.05))[documents], n[documents]
    place = np.where((places < edge) | (places >= size - edge), 0.5, 1.0)
    return half(np.where(size == 1, 1.0, scaled(half(0.6 * scaled(raw) + 0.4 * place, 10))), digits)


def chunk_importance(chunks: DataFrame, digits: int = 9) -> DataFrame:
    """document_id, chunk_index, content, importance_score: mean idf of the chunk's terms within the document and a lower
    weight at both ends, each scaled to 0..1. A document's only chunk has 1. Scores are rounded so that ties are ties.

    Chunks are dealt by document once; a task takes whole documents, one after the other, and scores some of them at a time."""
    ship(chunks.sparkSession)
    names, at_once = chunks.columns, 1_024

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(t: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = t.column("document_id").to_pylist()
            documents = np.cumsum([0, *(a != b for a, b in zip(ids, ids[1:], strict=False))])
            scores = document_scores(t.column("content").to_pylist(), t.column("chunk_index").to_numpy(), documents, digits)
            yield from t.append_column("importance_score", pa.array(scores)).to_batches()

        held: list[pa.RecordBatch] = []  # begins with a document
        rows = 0
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                batch = whole.slice(at, at_once)
                held, rows = [*held, batch], rows + batch.num_rows
                if rows < at_once:
                    continue
                t = pa.Table.from_batches(held)
                ids = batch.column("document_id").to_pylist()
                same = next((i for i in range(len(ids) - 1, -1, -1) if ids[i] != ids[-1]), None)  # the last row before the last document
                if same is None:
                    before = t.slice(0, rows - len(ids)).column("document_id").to_pylist() if rows < 4 * at_once else None
                    if before is None:  # a long document goes on
                        continue
                    same = next((i for i in range(len(before) - 1, -1, -1) if before[i] != ids[-1]), None)
                    if same is None:
                        continue
                    end = same + 1
                else:
                    end = rows - len(ids) + same + 1
                yield from scored(t.slice(0, end))
                held = t.slice(end).to_batches()
                rows -= end
        if rows:
            yield from scored(pa.Table.from_batches(held))

    kinds = [f"`{n}` {kind}" for n, kind in chunks.dtypes]
    dealt = chunks.repartition("document_id").sortWithinPartitions("document_id", "chunk_index")
    return dealt.select(*names).mapInArrow(work, ", ".join([*kinds, "importance_score double"]))


def highlights(scored: DataFrame, n: int = 8) -> DataFrame:
    """The n most important chunks of each document, each as its representative sentence."""
    w = Window.partitionBy("document_id").orderBy(F.col("importance_score").desc(), "chunk_index")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.select("document_id", F.col("rank").cast("long").alias("rank"), "chunk_index", representative_sentence(F.col("content")).alias("text"), F.round("importance_score", 4).alias("score"))


def outline(docs: DataFrame, chunks: DataFrame, text: str = "text", blocks: str | None = None) -> DataFrame:
    """Headings of each document in order, each once (by lower case), with the first chunk that contains it (else 0):
    document_id, heading, level, chunk_index, line_no (its place among all lines).

    With blocks, a heading block gives its own heading and level (0 or none is 1, at most 3) and any other block the lines of
    its text that look like headings (level 1), in the order of the blocks; without, the lines of a text column do."""
    entry = lambda heading, level: F.struct(heading.alias("heading"), level.alias("level"))
    told = lambda t: F.transform(F.split(F.coalesce(t, F.lit("")), _LINE_ENDS, -1), lambda x: entry(detect_heading(x), F.lit(1)))
    own = lambda b: F.array(entry(F.nullif(strip(b["heading"]), F.lit("")), F.least(F.greatest(F.coalesce(b["level"], F.lit(1)), F.lit(1)), F.lit(3))))
    explicit = lambda b: F.coalesce(b["is_heading"], F.lit(False)) & (F.coalesce(b["heading"], F.lit("")) != "")
    found = told(F.col(text)) if blocks is None else F.flatten(F.transform(blocks, lambda b: F.when(explicit(b), own(b)).otherwise(told(b["text"]))))
    heads = docs.select("document_id", F.posexplode(found).alias("pos", "e")).select("document_id", "pos", "e.*").where(F.col("heading").isNotNull())
    heads = heads.groupBy("document_id", F.lower("heading").alias("_k")).agg(F.min(F.struct("pos", "heading", "level")).alias("f")).select("document_id", "_k", "f.*")
    inside = heads.join(chunks.select("document_id", "chunk_index", F.lower("content").alias("_c")), "document_id").where(F.contains(F.col("_c"), F.col("_k")))
    first = inside.groupBy("document_id", "_k").agg(F.min("chunk_index").alias("chunk_index"))
    out = heads.join(first, ["document_id", "_k"], "left")
    return out.select("document_id", F.substring("heading", 1, 500).alias("heading"), "level", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.col("pos").alias("line_no"))
