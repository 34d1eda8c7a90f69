"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents are all wanted target / size times (at most `MOST` times): the whole part for each, the rest with a
copy probability. Probabilities are rounded in pairs: mass moves at random between two documents until one of them is
at 0 or 1, so that the expected copies of each document and the sum of size x probability of each group stay as they are.
A source's large documents are decided first, one after another, and the probability of all its others makes up for them.
Groups are then the documents of one source and size class (sizes within a factor of two), dealt to blocks of a fixed size;
each block leaves at most one document undecided, and these meet again in the next round of the reduction tree. What is
left, one document of each size class, is settled at the source's root from the largest down: each choice is passed on to
the smaller ones together, so a source misses its target by about its smallest undecided document.

Only (id, source, size) move, never texts. Rows equal in these are one group with a number of copies: of m equal
documents with probability p, floor(m p) are taken once more and one is undecided with the fraction. Every choice comes from
a hash of ids, sizes and round, so reruns agree whatever the partitions. Null texts and texts without words have size 0,
a source without words has target 0, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import join_groups, materialize, numbered, space_split
from ragmill.session import ship

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 256
#: A document of at least this share (1 / LARGE) of its source's words is decided before the others.
LARGE = 256
#: Rows of one generated array when equal rows are counted out again.
PIECE = 1_000
ROW = "doc_id {id}, tree string, source_size long, target double, base int, size long, cls int, p double, h long"
_MASK = (1 << 64) - 1


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """tree, source_size, target of each source. sizes: tree, source_size, a row each (tree: "s" and the source, or "t"
    for null, so that it sorts last), written.

    target = min(level * weight, most * size), where the level is raised until the targets add up to all sizes: sources
    above their bound give their excess to the others by weight. Each turn of the loop is one sum over the sources."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    rows = materialize(numbered(sizes.withColumn("all", F.lit(0)), "all", ["tree"], "mix-sources").select("tree", "source_size", w.alias("w"), (F.col("source_size") * most).alias("bound")), "mix-weights")
    row = rows.agg(F.sum("source_size").alias("t"), F.sum("w").alias("w")).first()
    total = row["t"] or 0
    level = total / row["w"] if total else 0.0
    while total:
        full = F.col("bound") <= level * F.col("w")
        row = rows.agg(F.sum(F.when(full, F.col("bound"))).alias("b"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if not row["w"] or (higher := (total - (row["b"] or 0)) / row["w"]) <= level:
            break
        level = higher
    return rows.select("tree", "source_size", F.least(F.col("w") * F.lit(float(level)), F.col("bound").cast("double")).alias("target"))


def _draw(a: int, b: int, turn: int) -> float:
    """A number in [0, 1) from two hashes and a round."""
    x = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F ^ (turn + 1) * 0x165667B19E3779F9) & _MASK
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> 30)) * m & _MASK
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivot(p: float, a: int, q: float, b: int, u: float) -> tuple[float, float]:
    """New probabilities of two documents of sizes a and b: a * p + b * q and both expectations stay, and one is 0 or 1."""
    up = min((1 - p) * a, q * b)  # words that can move from the second to the first
    down = min(p * a, (1 - q) * b)
    moved = up if u * (up + down) < down else -down
    p2, q2 = p + moved / a, q - moved / b
    snap = lambda v: 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
    if moved == up:  # what ended the move is exactly whole
        return (1.0, snap(q2)) if (1 - p) * a <= q * b else (snap(p2), 0.0)
    return (0.0, snap(q2)) if p * a <= (1 - q) * b else (snap(p2), 1.0)


def settle(sizes: list[int], p: list[float], draws: list[float], other: int = 0, q: float = 0.0) -> list[int]:
    """0 or 1 for documents given by falling size: near sum(size * p) in all, each choice being passed on to the smaller
    documents, and to `other` words of probability q that are decided later, together: their probabilities p become
    add + times * p. A document that the rest cannot make up for goes to the nearer side."""
    rest, mass = other + sum(sizes), other * q + sum(s * x for s, x in zip(sizes, p, strict=True))
    out, add, times = [], 0.0, 1.0
    for a, x, u in zip(sizes, p, draws, strict=True):
        want, chance = add * rest + times * mass, add + times * x
        rest, mass = rest - a, mass - a * x
        yes, no = a <= want * (1 + 1e-12), want <= rest * (1 + 1e-12)
        taken = int(u < chance) if yes and no else int(yes) if yes or no else int(a - want < want - rest)
        out.append(taken)
        have, left = want - a * chance, min(max(want - a * taken, 0.0), rest)
        if left <= have:
            k = left / have if have > 0 else 0.0
            add, times = add * k, times * k
        elif rest > have:
            k = (rest - left) / (rest - have)
            add, times = 1 - k + add * k, times * k
    return out


def _round(rows: DataFrame, turn: int, schema: str) -> DataFrame:
    """One round: undecided documents of a block are paired one after another, in the order of their hashes."""
    blocks = materialize(rows.groupBy("tree", "cls").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")), "mix-blocks")
    block = F.pmod(F.xxhash64("h", F.lit(turn)), F.col("nb")).cast("int")
    dealt = join_groups(rows, blocks, ["tree", "cls"], "inner").select(*rows.columns, block.alias("block"))
    dealt = dealt.repartition("tree", "cls", "block").sortWithinPartitions("tree", "cls", "block", "h", "doc_id", "size")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_row = None, None
        for batch in batches:
            done, names = [], [n for n in batch.schema.names if n != "block"]
            for row in batch.to_pylist():
                at = (row["tree"], row["cls"], row.pop("block"))
                if at != key:
                    if open_row is not None:
                        done.append(open_row)
                    key, open_row = at, row
                    continue
                u = _draw(open_row["h"], row["h"], turn)
                open_row["p"], row["p"] = pivot(open_row["p"], open_row["size"], row["p"], row["size"], u)
                if open_row["p"] in (0.0, 1.0):
                    done.append(open_row)
                    open_row = row
                else:
                    done.append(row)
                if open_row["p"] in (0.0, 1.0):
                    done.append(open_row)
                    key, open_row = None, None
            kinds = pa.schema([batch.schema.field(n) for n in names])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=kinds)
        if open_row is not None:
            yield pa.RecordBatch.from_pylist([open_row], schema=kinds)

    return materialize(dealt.mapInArrow(work, schema), f"mix-round{turn}")


def _settled(rows: DataFrame, turn: int, schema: str) -> DataFrame:
    """Settle a source's few rows: its large documents, or what it has left of each size class. The last two columns of
    rows are the source's other words and their probability."""
    dealt = rows.repartition("tree").sortWithinPartitions("tree", F.col("size").desc(), "h", "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kinds = [], None

        def closed() -> pa.RecordBatch:
            draws = [_draw(r["h"], i, turn) for i, r in enumerate(group)]
            found = settle([r["size"] for r in group], [r["p"] for r in group], draws, group[0]["other"], group[0]["q"])
            for r, x in zip(group, found, strict=True):
                r["p"] = float(x)
            return pa.RecordBatch.from_pylist(group, schema=kinds)

        for batch in batches:
            kinds = pa.schema([f for f in batch.schema if f.name not in ("other", "q")])
            for row in batch.to_pylist():
                if group and group[0]["tree"] != row["tree"]:
                    yield closed()
                    group = []
                group.append(row)
        if group:
            yield closed()

    return dealt.mapInArrow(work, schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    ship(docs.sparkSession)
    schema = ROW.format(id=dict(docs.dtypes)["doc_id"])
    size = F.coalesce(F.size(space_split(F.col("text"))), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("tree"), F.when(F.col("text").isNull(), 0).otherwise(size).alias("size"))
    rows = materialize(rows.groupBy("doc_id", "tree", "size").agg(F.count("*").alias("m")), "mix-documents")
    sizes = materialize(rows.groupBy("tree").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), "mix-sizes")
    rows = join_groups(rows, materialize(source_targets(sizes, weights, most), "mix-targets"), ["tree"], "inner")

    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(times).cast("int")).withColumn("p", times - F.col("base")).withColumn("h", F.xxhash64("doc_id", "size")).withColumn("cls", F.length(F.bin("size")))
    names = [f.split(" ")[0] for f in schema.split(", ")]
    result = ["doc_id", "source_size", "target", "base", "size", "p"]
    large = F.col("size") * LARGE >= F.greatest("source_size", F.lit(1))

    # a source's large documents, at most LARGE, copies counted out; the probability of its others follows
    each = rows.where(large).withColumn("_i", F.explode(F.array_repeat(F.lit(0), F.col("m").cast("int"))))
    whole = rows.groupBy("tree").agg(F.sum(F.when(large, 0).otherwise(F.col("size") * F.col("m"))).alias("other"), F.max("p").alias("q"))
    decided = materialize(_settled(join_groups(each, materialize(whole, "mix-others"), ["tree"], "inner").select(*names, "other", "q"), -1, schema), "mix-large")
    moved = decided.groupBy("tree").agg(F.sum(F.col("size") * F.col("p")).alias("got"), F.sum("size").alias("held"))
    rest = join_groups(rows.where(~large), materialize(moved, "mix-moved"), ["tree"])
    words = F.col("source_size") - F.coalesce("held", F.lit(0))
    wanted = F.col("p") * F.col("source_size") - F.coalesce("got", F.lit(0.0))
    rest = rest.withColumn("p", F.when(words > 0, F.least(F.greatest(wanted / words, F.lit(0.0)), F.lit(1.0))).otherwise(0.0))

    # of m equal rows so many are taken once more, at most one is open with a fraction
    more = F.when(F.col("size") > 0, F.col("m") * F.col("p")).otherwise(0.0)
    rest = rest.withColumn("more", more).withColumn("whole", F.floor(F.col("more") + 1e-9)).withColumn("p", F.greatest(F.col("more") - F.col("whole"), F.lit(0.0)))
    rows = materialize(rest.withColumn("open", (F.col("p") > 1e-9).cast("long")), "mix-rows")

    counted = rows.select("doc_id", "tree", "source_size", "target", "base", "size", F.explode(F.array(F.struct(F.lit(1.0).alias("p"), F.col("whole").alias("c")), F.struct(F.lit(0.0).alias("p"), (F.col("m") - F.col("whole") - F.col("open")).alias("c")))).alias("r"))
    counted = counted.select("*", "r.p", "r.c").where(F.col("c") > 0)
    # equal rows again as many rows, in two steps of bounded arrays
    counted = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(PIECE).cast("long"))))
    counted = counted.withColumn("_i", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + PIECE, F.col("c")) - 1)))
    settled = [decided.select(*result), counted.select(*result)]

    pending, turn = rows.where(F.col("open") == 1).select(*names), 0
    while pending.groupBy("tree", "cls").count().where(F.col("count") > 1).limit(1).count():
        out = _round(pending, turn, schema)
        settled.append(out.where(F.col("p").isin(0.0, 1.0)).select(*result))
        pending, turn = out.where(~F.col("p").isin(0.0, 1.0)), turn + 1
    none = [F.lit(0).cast("long").alias("other"), F.lit(0.0).alias("q")]
    settled.append(_settled(pending.select("*", *none), turn, schema).select(*result))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("doc_id", "size", "source_size", "target", ((F.col("base") + F.col("p").cast("long")) * F.col("size")).alias("taken"))
