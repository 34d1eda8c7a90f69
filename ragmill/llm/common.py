"""Shared pieces of the training-data operators: word rules, the cluster's shared folder, written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragmill.session import shared_dir, written

#: The two word rules of the operators and the ASCII letters that are lower-cased.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take Spark's fast lower(); others keep every non-ASCII capital."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def space_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({SPACE_WORD})"), F.lit(1))


def space_split(text: Column) -> Column:
    """The same words as space_words, by splitting at white space."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), "")


def alnum_words(text: Column) -> Column:
    """Words of an already lower-cased text."""
    return F.regexp_extract_all(text, F.lit(f"({ALNUM_WORD})"), F.lit(1))


def alnum_split(text: Column) -> Column:
    """The same words as alnum_words, by splitting at what stands between them."""
    return F.array_remove(F.split(text, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", -1), "")


def bucket_of(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors, and
    gives the planner exact sizes, so that it broadcasts only what is really small."""
    return written(df, label)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what a worker makes of a batch of long texts is several times its size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


GROUPS = 10_000
SALTS = 64


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "left", n: int | None = None) -> DataFrame:
    """Join written rows with a table of a few rows for each group. Groups of up to GROUPS rows in all (a few hundred bytes
    each; n if it is known, else counted) are broadcast; beyond that each group's rows are dealt over SALTS keys, so no
    hot group meets in one task."""
    if (groups.count() if n is None else n) <= GROUPS:
        return rows.join(F.broadcast(groups), on, how)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns), F.lit(SALTS)).cast("int")  # the same if a task runs again
    return rows.withColumn("_salt", salt).join(salted, [*on, "_salt"], how).drop("_salt")


HOT = 10_000


def join_unique(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join written rows with a table of at most one row for each key, without nulls in the key. A key is hot if it has
    more than HOT rows and more than one GROUPS-th of all rows, so fewer than GROUPS keys are: these meet their rows of the
    table by broadcast, all others in a join of Spark's choice."""
    least = max(HOT, rows.count() // GROUPS)
    sizes = rows.groupBy(*on).agg(F.count("*").alias("_n"))  # counted in each task first
    hot = materialize(sizes.where(F.col("_n") > least).select(*on, F.lit(True).alias("_hot")), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, on, how)
    dealt = rows.join(F.broadcast(hot), on, "left")
    few = table.join(F.broadcast(hot.drop("_hot")), on, "left_semi")
    met = dealt.where("_hot").drop("_hot").join(F.broadcast(few), on, how)
    return met.unionByName(dealt.where(F.col("_hot").isNull()).drop("_hot").join(table, on, how))


def numbered(rows: DataFrame, by: str, order: list[str], label: str) -> DataFrame:
    """rows with pos (place from 0 among the rows of the same `by`, sorted by `order`, nulls first) and n (their number).

    Rows are dealt by ranges of (by, order), so a hot group lies in many tasks; only a count for each group and task is
    summed over tasks. rows must be a written table: it is read twice. Rows equal in all these columns are told apart by
    their place in the table, so they too lie in many tasks."""
    keys = [F.col(c).asc_nulls_first() for c in (by, *order, "_place")]
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    # the number of a task and of the row in it, kept in the written rows
    dealt = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place").withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_task", F.shiftright("_at", 33)), label)
    counts = dealt.groupBy(by, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    tasks = Window.partitionBy(by)  # a row for each task that has rows of the group
    before = F.coalesce(F.sum("_n").over(tasks.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(by, "_task", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tasks).alias("n"))
    starts = materialize(starts, f"{label}-starts")
    return dealt.join(starts, [by, "_task"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file on this machine: a name is asked of the installed package, a path stays."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))
