"""Cutting documents into blocks and chunks; every step stays in the document's own row until the final explode."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.functions.text import detect_heading, let, row_text, split_sentences, strip
from ragmill.session import ship

#: Window and overlap in characters; characters of a packed chunk and sentences of overlap.
SIZE, OVERLAP, PACKED, SENTENCES = 800, 150, 3_200, 2
BLOCKS = "array<struct<text:string,page:int,heading:string,level:int,is_heading:boolean>>"


def _check(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap in [0, size)")


def _starts(n: Column, size: int, overlap: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


#: What strip() of functions.text takes as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def windows(text: str | None, size: int = SIZE, overlap: int = OVERLAP, most: int | None = None) -> list[str]:
    """Overlapping character windows of a stripped text, each stripped, without empty ones; the first `most` if given."""
    t, found = (text or "").strip(WHITE), []
    for s in range(0, max(len(t) - overlap, 1), size - overlap) if t else ():
        if part := t[s : s + size].strip(WHITE):
            found.append(part)
            if len(found) == most:
                break
    return found


def chunk_text(docs: DataFrame, keep: list[str], text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping character windows of each text: keep columns, chunk_index, content. Texts are cut by a Python step in the
    task that reads them, as substrings by character within a row are slow on long texts in the JVM."""
    _check(size, overlap)
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                cut = [windows(t, size, overlap) for t in b.column("_t").to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(cut)), [len(x) for x in cut]))
                index = np.concatenate([np.arange(len(x), dtype=np.int32) for x in cut]) if cut else np.array([], np.int32)
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(rows) for i in range(len(keep))], pa.array(index, pa.int32()), pa.array([x for one in cut for x in one], pa.string())], names=[*keep, "chunk_index", "content"])

    d = docs.select(*keep, F.col(text).alias("_t"))
    kept = [f"`{n}` {kind}" for n, kind in d.dtypes[:-1]]
    return d.mapInArrow(work, ", ".join([*kept, "chunk_index int", "content string"]))


def line_blocks(text: Column) -> Column:
    """A text's lines as blocks: five to a page, headings told by their looks."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    block = lambda x, i: lambda h: F.struct(x.alias("text"), (1 + F.floor(i / 5)).cast("int").alias("page"), h.alias("heading"), F.when(h.isNotNull(), 1).otherwise(0).alias("level"), h.isNotNull().alias("is_heading"))
    return F.transform(lines, lambda x, i: let(detect_heading(x), block(x, i))).cast(BLOCKS)


def paragraph_blocks(text: Column) -> Column:
    """Paragraphs (between blank lines) as blocks of page 1."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), strip), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(x.alias("text"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("heading"), F.lit(0).alias("level"), F.lit(False).alias("is_heading"))).cast(BLOCKS)


def table_blocks(rows: DataFrame, keep: list[str], columns: list[str], heading: str | None = None) -> DataFrame:
    """A block for each row of any table: keep columns, text ("name: value" of the non-empty columns) and heading (say the
    sheet's name). Rows without a value give no block."""
    return rows.select(*keep, row_text(columns).alias("text"), F.lit(heading).cast("string").alias("heading")).where("text <> ''")


def _csv_rows(texts: pd.Series) -> pd.Series:
    csv.field_size_limit(2**31 - 1)

    def one(text: str | None) -> list[str]:
        lines = csv.reader(io.StringIO(text or ""))
        labels = [h.strip() if h else "Column" for h in next(lines, [])]
        rendered = (", ".join(f"{label}: {value}" for label, value in zip(labels, line, strict=False) if value != "") for line in lines)
        return [r for r in rendered if r]

    return texts.map(one)


def csv_blocks(files: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Data rows of each CSV text as blocks: keep columns, row_no, text. Empty names read "Column", empty values are left out,
    values beyond the header (or missing ones) are dropped; quoted fields may hold commas, quotes and line ends."""
    ship(files.sparkSession)
    return files.select(*keep, F.posexplode(F.pandas_udf(_csv_rows, "array<string>")(F.col(text))).alias("row_no", "text"))


def blocks_to_text(blocks: Column) -> Column:
    return F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda x: x.isNotNull() & (x != "")), "\n\n")


def page_count(blocks: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(blocks, lambda b: b["page"])), F.lit(0))


_SPAN = "array<struct<text:string,start:int,page:int,section:string>>"


def _spans(docs: DataFrame, keep: list[str], blocks: str) -> DataFrame:
    """Non-empty blocks with their place in the joined text, page and carried-forward section (columns _s, _n)."""
    stripped = "CASE WHEN rlike(concat(left(b.text, 1), right(b.text, 1)), '(?U)\\\\s') THEN regexp_replace(b.text, '(?U)^\\\\s+|\\\\s+$', '') ELSE coalesce(b.text, '') END"
    full = f"filter(transform({blocks}, b -> named_struct('t', {stripped}, 'page', coalesce(b.page, 1), 'h', b.heading, 'is', coalesce(b.is_heading, false))), b -> b.t <> '')"
    kind = f"struct<n:int,cur:string,out:{_SPAN}>"
    sec = "CASE WHEN b.is THEN b.h ELSE a.cur END"
    step = f"(a, b) -> cast(named_struct('n', a.n + length(b.t) + 2, 'cur', CASE WHEN b.is THEN coalesce(b.h, b.t) ELSE a.cur END, 'out', array_append(a.out, named_struct('text', b.t, 'start', a.n, 'page', b.page, 'section', {sec}))) AS {kind})"
    d = docs.selectExpr(*keep, f"{full} AS _b")
    return d.selectExpr(*keep, f"aggregate(_b, cast(named_struct('n', 0, 'cur', null, 'out', array()) AS {kind}), {step}, a -> a.out) AS _s")


def chunk_blocks(docs: DataFrame, keep: list[str], blocks: str = "blocks", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows over the joined blocks with page and section of the block that a window starts in (or the last before)."""
    _check(size, overlap)
    d = _spans(docs, keep, blocks).withColumn("_t", F.rtrim(F.array_join(F.transform("_s", lambda s: s["text"]), "\n\n")))
    t, s = F.col("_t"), F.col("_s")

    def window(at: Column) -> Column:
        inside = F.element_at(F.filter(s, lambda x: x["start"] <= at), -1)
        return F.struct(strip(F.substring(t, at + 1, F.lit(size))).alias("content"), inside["page"].alias("page_number"), inside["section"].alias("section_heading"))

    cut = F.filter(F.transform(_starts(F.length(t), size, overlap), window), lambda x: x["content"] != "")
    return d.select(*keep, F.posexplode(cut).alias("chunk_index", "c")).select(*keep, "chunk_index", "c.*")


def packed_ranges(lengths: Column, limit: int, overlap: int) -> Column:
    """Ranges (a, b) of sentences packed up to limit characters (one more for each joining space); the next range starts
    `overlap` sentences back, but after the start of the one before. A fold over two indices: each of its steps closes one
    range, which is measured on the next sentences alone (limit / 2 at most, as each takes two characters with its space)."""
    ranges, window = "array<struct<a:int,b:int>>", limit // 2 + 2

    def close(state: Column) -> Column:
        fits = lambda t, n: (n["n"] == 0) | (n["total"] + 1 + t <= limit)
        add = lambda n, t: F.when(n["open"] & fits(t, n), _state(n["total"] + t + F.when(n["n"] == 0, 0).otherwise(1), n["n"] + 1, F.lit(True))).otherwise(_state(n["total"], n["n"], F.lit(False)))
        taken = F.aggregate(F.slice(lengths, state["at"] + 1, window), _state(F.lit(0), F.lit(0), F.lit(True)), add, lambda n: n["n"])
        return let(state["at"] + taken, lambda end: _step(F.when(end < F.size(lengths), F.greatest(state["at"] + 1, end - overlap)).otherwise(F.size(lengths)), F.array_append(state["out"], F.struct(state["at"].alias("a"), end.alias("b")).cast("struct<a:int,b:int>"))))

    _state = lambda total, n, free: F.struct(total.cast("int").alias("total"), n.cast("int").alias("n"), free.alias("open"))
    _step = lambda at, out: F.struct(at.cast("int").alias("at"), out.cast(ranges).alias("out"))
    return F.aggregate(lengths, _step(F.lit(0), F.array()), lambda s, _: F.when(s["at"] < F.size(lengths), close(s)).otherwise(s), lambda s: s["out"])


def chunk_semantic(docs: DataFrame, keep: list[str], blocks: str = "blocks", limit: int = PACKED, overlap: int = SENTENCES) -> DataFrame:
    """Whole sentences packed up to a size; the next chunk repeats the last sentences. Page and section are those of the
    first sentence. All within the document's row."""
    if limit <= 0 or overlap < 0:
        raise ValueError("limit must be positive and overlap >= 0")
    s = _spans(docs, keep, blocks)
    sents = F.flatten(F.transform("_s", lambda b: F.transform(split_sentences(b["text"]), lambda x: F.struct(x.alias("t"), b["page"].alias("page"), b["section"].alias("section")))))

    def chunk(x: Column, r: Column) -> Column:
        first = F.get(x, r["a"])
        return F.struct(F.array_join(F.transform(F.slice(x, r["a"] + 1, r["b"] - r["a"]), lambda y: y["t"]), " ").alias("content"), first["page"].alias("page_number"), first["section"].alias("section_heading"))

    def packed(x: Column) -> Column:
        ranges = let(F.transform(x, lambda y: F.length(y["t"])), lambda n: packed_ranges(n, limit, overlap))
        return let(ranges, lambda found: F.transform(found, lambda r: chunk(x, r)))

    return s.select(*keep, F.posexplode(let(sents, packed)).alias("chunk_index", "c")).select(*keep, "chunk_index", "c.*")
