"""Corpus pipeline: quality rules, quality classifier, n-gram Jaccard join, benchmark decontamination, BPE round trip.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
`documents`; the last returns the encoding of each text that is left. Repeated ids, nulls and copies are safe: rows are
told apart by a digest of all their columns, and rows equal in all columns have the same verdict. Quality rules,
classifier and near duplicates write the digests of what goes; up to GONE of them are broadcast and no text is shuffled. Extra columns are dropped by the first stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm import bpe, decontam, jaccard, pu, quality
from ragmill.llm.common import fresh_path, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
GONE = 200_000  # digests (16 bytes each) of rows to drop that are broadcast; beyond it they meet the rows in a merge join
ORACLE_SQL = None  # robust estimates, a trained classifier and BPE are beyond SQL


def _row_digest() -> Column:
    """Digest of all columns; rows that share it are equal."""
    return F.unhex(F.md5(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"})))


def _bounded(digests: DataFrame) -> DataFrame:
    """digests, a written table, to be broadcast if it has at most GONE rows."""
    return F.broadcast(digests) if digests.count() <= GONE else digests


def _without(docs: DataFrame, verdicts: DataFrame, label: str) -> DataFrame:
    """The rows of docs whose digest is not in column _r of verdicts. The digests are written and joined with the texts
    once, so no second copy of the texts is written."""
    gone = _bounded(materialize(verdicts.select("_r").distinct(), label))
    return docs.join(gone, "_r", "left_anti").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("_r", _row_digest())


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that fail the base rules or are robust outliers of their language and source."""
    keyed = _keyed(docs)
    return _without(keyed, quality.quality_rules(keyed, keep=["_r"]).where(~F.col("kept")), "pipeline-outliers")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that the positive-unlabelled classifier scores below its threshold."""
    labels, keyed = spark.read.parquet(f"{sf_dir}/labels.parquet"), _keyed(docs)
    return _without(keyed, pu.pu_scores(keyed, labels, keep=["_r"]).where(F.col("predicted") == 0), "pipeline-rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate class: the least id (nulls last), of its rows that of the least digest, of
    equal rows one. Texts without words stay. The decision is made on digests; texts are joined with it once, and once
    more, for the rows in question alone, if kept rows are repeated."""
    keyed = _keyed(docs)
    rows = materialize(jaccard.jaccard_join(keyed, row_key="_r").where(F.col("class_key").isNotNull()).select("doc_id", "_r", "class_key"), "pipeline-classes")
    first = rows.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_r")).alias("f"))
    first = materialize(first.select(F.col("f._r").alias("_r")), "pipeline-first")
    counts = rows.groupBy("_r").agg(F.count("*").alias("n")).join(first.withColumn("_first", F.lit(True)), "_r", "left")
    held = materialize(counts.where(F.col("_first").isNull() | (F.col("n") > 1)).select("_r", "_first"), "pipeline-held")  # all but rows that just stay
    again = materialize(held.where("_first").select("_r"), "pipeline-repeated")
    alone = keyed.join(_bounded(held.select("_r")), "_r", "left_anti").select(*COLUMNS)
    if again.isEmpty():
        return alone
    # equal rows: one of them in each task, then one of all
    equal = keyed.join(_bounded(again), "_r", "left_semi").groupBy("_r").agg(F.first(F.struct(*COLUMNS)).alias("d"))
    return alone.unionByName(equal.select("d.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in which a window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contamination(docs, items, keep=COLUMNS).where(~F.col("contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left."""
    return bpe.encode_decode(docs, "word_bpe_49k.json", digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe_round_trip", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
