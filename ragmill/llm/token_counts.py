"""Exact length histogram: documents by encoded length, with suffix sums that answer every context limit.

Defined cases: null and empty texts have length 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_024  # lengths whose running sums are made together; the blocks' totals carry over


def length_histogram(lengths: DataFrame, length_col: str = "length") -> DataFrame:
    """Rows (length, n_docs, n_tokens) from one length per document: one partial count per length and task."""
    return lengths.groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count("*").alias("n_docs")).withColumn("n_tokens", F.col("length") * F.col("n_docs"))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L as a context limit: documents and tokens of at least L, tokens kept if texts are cut at L,
    documents cut, documents of at most L and their share. Sums run within blocks of lengths, then over blocks, so no
    task holds all lengths. The histogram is read several times, so pass a written one."""
    blocks = hist.withColumn("block", F.floor(F.col("length") / BLOCK))
    totals = blocks.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per 1024 lengths
    carried = totals.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("cd"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("ct"))
    total = totals.agg(F.sum("bd").alias("all_docs"), F.sum("bt").alias("all_tokens"))
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.join(F.broadcast(carried), "block").join(F.broadcast(total))  # one row; blocks are few: max length / 1024
    ge_d, ge_t = F.sum("n_docs").over(within) + F.col("cd"), F.sum("n_tokens").over(within) + F.col("ct")
    out = out.withColumns({"docs_ge": ge_d, "tokens_ge": ge_t})
    le = F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")
    return out.select(
        "length", "n_docs", "n_tokens", "docs_ge", "tokens_ge",
        (F.col("docs_ge") - F.col("n_docs")).alias("docs_cut"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("tokens_at_limit"),
        le.alias("docs_le"),
        F.round(le / F.col("all_docs"), 9).alias("share_le"),
        "all_docs", "all_tokens",
    )


def quantile_lengths(table: DataFrame, probabilities: list[float]) -> DataFrame:
    """Exact lower quantiles from the suffix-sum table: the least length whose share of documents reaches p."""
    ps = table.sparkSession.createDataFrame([(float(p),) for p in probabilities], "p double")
    hit = table.join(F.broadcast(ps), F.col("docs_le") >= F.ceil(F.col("p") * F.col("all_docs")))
    return hit.groupBy("p").agg(F.min("length").alias("length"))
