"""A stored BM25 index: postings in buckets of tenants and terms, grown batch by batch.

Tables below the index' folder, each with a folder per batch:

* `postings`: group, term, id, tf, len, in partitions by bucket of the group and bucket of the term
* `terms`: group, term, df in the same partitions
* `ids`: group, id by bucket of the group
* `sizes`: group, n, total (chunks and their tokens)
* `spread`: group, df, terms: how many terms of a group occur in df chunks, as changes to be summed

A search reads only the partitions of its questions' groups and terms. A merge writes one more batch: it reads the df of
its own terms' partitions to change the spread, from which the mean idf (the floor of frequent terms) follows; nothing
that is stored is written again. A batch repeated under its number replaces itself. Chunk ids of a batch must be new.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.functions.text import bm25_tokens, term_counts
from ragmill.session import fresh, written

#: BM25 parameters.
K1, B, EPS = 1.5, 0.75, 0.25
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 4_096
_KEY = "gb int, tb int"
_SCHEMAS = {
    "postings": f"group string, term string, id long, tf long, len int, batch int, {_KEY}",
    "terms": f"group string, term string, df long, batch int, {_KEY}",
    "ids": "group string, id long, batch int, gb int",
    "sizes": "group string, n long, total long, batch int",
    "spread": "group string, df long, terms long, batch int",
}


@dataclass
class StoredIndex:
    """Handle of an index: where it lies, its numbers of buckets and the batches that count."""

    spark: SparkSession
    path: str
    groups: int
    terms: int
    batches: int

    def _buckets(self, rows: DataFrame, term: bool = True) -> DataFrame:
        out = rows.withColumn("gb", F.pmod(F.xxhash64("group"), F.lit(self.groups)).cast("int"))
        return out.withColumn("tb", F.pmod(F.xxhash64("term"), F.lit(self.terms)).cast("int")) if term else out

    def read(self, name: str, before: int | None = None) -> DataFrame:
        last = self.batches if before is None else before
        if not last:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}").where(F.col("batch") < last)

    def _write(self, rows: DataFrame, name: str, batch: int, by: list[str]) -> None:
        out = rows.hint("rebalance", *by).sortWithinPartitions(*by, "group") if by else rows  # a hot tenant's term is split
        writer = out.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{name}/batch={batch}")

    def pruned(self, name: str, keys: DataFrame, before: int | None = None) -> DataFrame:
        """Rows of a table in the partitions that hold keys (group, term). The partitions' numbers, at most groups x terms
        of them, become a filter on folders, so other partitions are never listed as input."""
        held = defaultdict(list)
        for r in self._buckets(keys).select("gb", "tb").distinct().collect():
            held[r["gb"]].append(r["tb"])
        where: Column = F.lit(False)
        for gb, tbs in sorted(held.items()):
            where = where | ((F.col("gb") == gb) & F.col("tb").isin(sorted(tbs)))
        return self.read(name, before).where(where)

    def merge(self, chunks: DataFrame, batch: int | None = None) -> StoredIndex:
        """The index with one more batch of chunks (group, id, content) in it."""
        batch = self.batches if batch is None else batch
        toks = chunks.select("group", "id", bm25_tokens(F.col("content")).alias("t"))
        counted = toks.select("group", "id", F.size("t").alias("len"), F.explode(term_counts(F.col("t"))).alias("c")).select("group", "c.term", "id", "c.tf", "len")
        self._write(self._buckets(counted), "postings", batch, ["gb", "tb"])
        lengths = written(toks.select("group", "id", F.size("t").alias("len")), "bm25-lengths")
        self._write(self._buckets(lengths, term=False).select("group", "id", "gb"), "ids", batch, ["gb"])
        self._write(lengths.groupBy("group").agg(F.count("*").alias("n"), F.sum("len").alias("total")), "sizes", batch, [])
        mine = self.spark.read.schema(_SCHEMAS["postings"].replace(", batch int", "")).parquet(f"{self.path}/postings/batch={batch}")
        self._write(mine.groupBy("group", "term", "gb", "tb").agg(F.count("*").alias("df")), "terms", batch, ["gb", "tb"])

        new = self.spark.read.schema(_SCHEMAS["terms"].replace(", batch int", "")).parquet(f"{self.path}/terms/batch={batch}").select("group", "term", "df")
        change = new.withColumn("was", F.lit(0).cast("long"))
        if batch:
            old = self.pruned("terms", new, batch).groupBy("group", "term").agg(F.sum("df").alias("was"))
            change = new.join(old, ["group", "term"], "left").withColumn("was", F.coalesce("was", F.lit(0)))
        moves = F.array(F.struct((F.col("was") + F.col("df")).alias("df"), F.lit(1).alias("terms")), F.struct(F.col("was").alias("df"), F.lit(-1).alias("terms")))
        moves = change.select("group", F.explode(moves).alias("m")).where("m.df > 0").groupBy("group", "m.df").agg(F.sum("m.terms").alias("terms"))
        self._write(moves.where("terms <> 0"), "spread", batch, [])
        return StoredIndex(self.spark, self.path, self.groups, self.terms, max(self.batches, batch + 1))

    def sizes(self) -> DataFrame:
        """group, n, avgdl and floor (the idf of terms in more than half of the chunks)."""
        size = self.read("sizes").groupBy("group").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl"))
        spread = self.read("spread").groupBy("group", "df").agg(F.sum("terms").alias("terms")).join(size.select("group", "n"), "group")
        floor = spread.groupBy("group").agg((EPS * F.sum(F.col("terms") * raw_idf()) / F.sum("terms")).alias("floor"))
        return size.join(floor, "group", "left")

    def idf(self, keys: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
        """group, term, idf, n, avgdl of the terms in keys, or of all."""
        rows = self.read("terms") if keys is None else self.pruned("terms", keys).join(keys.select("group", "term").distinct(), ["group", "term"], "left_semi")
        df = rows.groupBy("group", "term").agg(F.sum("df").alias("df")).join(self.sizes() if sizes is None else sizes, "group")
        return df.select("group", "term", F.when(raw_idf() < 0, F.col("floor")).otherwise(raw_idf()).alias("idf"), "n", "avgdl")

    def largest_ids(self, groups: DataFrame, limit: int) -> DataFrame:
        """group, ids: up to `limit` largest ids of each group. First within slices of a group, then within the group; the
        optimiser limits both in each task before the shuffle (up to its threshold), so a tenant's ids never meet."""
        from pyspark.sql import Window

        buckets = [r["gb"] for r in self._buckets(groups.select("group"), term=False).select("gb").distinct().collect()]  # at most self.groups
        rows = self.read("ids").where(F.col("gb").isin(buckets)).select("group", "id").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(64)))
        first = lambda rows, *by: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("id").desc()))).where(F.col("_r") <= limit).drop("_r")
        return first(first(rows, "group", "_s"), "group").groupBy("group").agg(F.sort_array(F.collect_list("id"), asc=False).alias("ids"))


def raw_idf() -> Column:
    return F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def build(chunks: DataFrame, path: str | None = None, groups: int | None = None, terms: int | None = None) -> StoredIndex:
    """A new index of chunks (group, id, content), in the shared folder if no path is given. Without numbers of buckets there
    is one for about BUCKET_BYTES of text, MOST_BUCKETS at most, a quarter of their power of two by group."""
    spark = chunks.sparkSession
    if groups is None or terms is None:
        size = chunks.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        power = min(MOST_BUCKETS, max(4, size // BUCKET_BYTES)).bit_length() - 1
        groups, terms = groups or 1 << power // 4, terms or 1 << power - power // 4
    return StoredIndex(spark, path or fresh(spark, "bm25-index"), groups, terms, 0).merge(chunks)
