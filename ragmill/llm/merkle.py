"""Merkle manifest of a dataset: a ternary hash tree per source and one over the sources, in van Emde Boas order.

A tree's leaves are cut into aligned blocks, each the subtree over 3**b consecutive leaves, where b is half of the
tree's height; the roots of the blocks are the leaves of the same tree's next tier, which is cut again, until one block
holds a whole tier. A block's nodes are stored as one array in van Emde Boas order: the upper half of its levels first,
then each subtree below, both in the same order recursively. `address` finds a node by arithmetic alone; building reads
children and retrieval reads siblings through it. A task handles one block at a time, so no group is larger than
3**WHOLE or 3**MOST leaves, and a hot source is spread over as many tasks as it has blocks.

Ids that are null come first and are never tampered with, equal rows have neighbouring equal leaves, a null source is a
source of its own, a source of one row has that row's leaf as its root, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import materialize, numbered
from ragmill.session import ship

FAN = 3
#: A tier of at most this height is one block; higher ones are cut at half height, at most at MOST.
WHOLE, MOST = 5, 8
POWERS = [FAN**k for k in range(39)]
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DIGEST = 32


def nodes_of(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes `index` of one depth (0: the root) in the van Emde Boas order of a tree of so many levels."""
    at = np.zeros_like(index)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth, lower = depth - upper, levels - upper
        width = FAN**depth
        at = at + nodes_of(upper) + index // width * nodes_of(lower)
        index, levels = index % width, lower
    return at


@cache
def _places(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(FAN**depth))


def build_block(leaves: list[bytes], height: int) -> np.ndarray:
    """Nodes of the subtree over up to 3**height leaves: rows of bytes in van Emde Boas order, absent nodes zero."""
    nodes, count = np.zeros((nodes_of(height + 1), DIGEST), np.uint8), len(leaves)
    nodes[_places(height + 1, height)[:count]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, DIGEST)
    for depth in range(height, 0, -1):
        below = nodes[_places(height + 1, depth)[:count]].tobytes()
        run = FAN * DIGEST
        above = b"".join(hashlib.sha256(below[i : i + run].hex().encode()).digest() for i in range(0, len(below), run))
        count = len(above) // DIGEST
        nodes[_places(height + 1, depth - 1)[:count]] = np.frombuffer(above, np.uint8).reshape(-1, DIGEST)
    return nodes


def block_paths(nodes: np.ndarray, height: int, count: int) -> list[list[str]]:
    """For each of the block's `count` leaves: the siblings' digests to the left and to the right, level by level upwards."""
    levels = []
    for depth in range(height, 0, -1):
        levels.append(nodes[_places(height + 1, depth)[:count]].tobytes().hex())
        count = -(-count // FAN)
    wide, text = FAN * 2 * DIGEST, 2 * DIGEST
    found: list[list[str]] = []
    for i in range(len(levels[0]) // text if levels else count):
        path, j = [], i
        for level in levels:
            j, k = divmod(j, FAN)
            run = level[wide * j : wide * (j + 1)]
            path += (run[: text * k], run[text * (k + 1) :])
        found.append(path)
    return found


def fold(digest: str, path: list[str]) -> str:
    """Root that a node's digest and its siblings give."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def field_text(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    """SHA-256 of a row's fields, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field_text(text if f == "text" else F.col(f)) for f in FIELDS]), 256))


def dataset_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the source; null sources sort first), digest, and tampered: the digest without line ends in the
    text, for rows whose id's crc32 is even."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), leaf_digest(F.col("text")).alias("digest"), F.when(hit, leaf_digest(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))


def build_tiers(leaves: DataFrame, label: str, carry: tuple[str, ...] = ()) -> list[DataFrame]:
    """Written tiers of the trees over leaves (tree, pos, n, digest and the columns to carry), the lowest first: a row for
    each block with tree, block, b (its height), height (what is left of the tree's), count, nodes, root and the carried
    columns as arrays in order of the leaves."""
    spark = leaves.sparkSession
    ship(spark)
    powers = F.array(*map(F.lit, POWERS))
    level, tiers, rest = leaves.withColumn("height", F.size(F.filter(powers, lambda p: p < F.col("n")))), [], carry
    while True:
        cut = level.withColumn("b", F.when(F.col("height") <= WHOLE, F.col("height")).otherwise(F.least(F.ceil(F.col("height") / 2), F.lit(MOST)).cast("int")))
        cut = cut.withColumn("width", F.element_at(powers, F.col("b") + 1)).withColumn("block", F.expr("pos div width"))
        rows = cut.groupBy("tree", "height", "b", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *rest))).alias("r"))  # at most 3 ** MOST
        rows = rows.select("tree", "height", "b", "block", F.col("r.digest").alias("digests"), *[F.col(f"r.{c}").alias(c) for c in rest])

        def work(batches: Iterator[pa.RecordBatch], kept: tuple[str, ...] = tuple(rest)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    digests, b = one.column("digests")[0].as_py(), one.column("b")[0].as_py()
                    nodes = build_block(digests, b)
                    names = ["tree", "height", "b", "block", *kept]
                    cols = [one.column(c) for c in names] + [pa.array([len(digests)], pa.int32()), pa.array([nodes.tobytes()]), pa.array([nodes[0].tobytes()])]
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, "count", "nodes", "root"])

        kinds = dict(rows.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("tree", "height", "b", "block", *rest)) + ", count int, nodes binary, root binary"
        stored = materialize(rows.mapInArrow(work, schema), f"{label}-tier{len(tiers)}")
        tiers.append(stored)
        level, rest = stored.where(F.col("height") > F.col("b")).select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"), (F.col("height") - F.col("b")).alias("height")), ()
        if level.isEmpty():
            return tiers


def tree_roots(tiers: list[DataFrame]) -> DataFrame:
    """tree, root: from the tier in which each tree ends."""
    out = None
    for t in tiers:
        ends = t.where(F.col("height") == F.col("b")).select("tree", F.col("root"))
        out = ends if out is None else out.unionByName(ends)
    return out


def block_paths_down(tiers: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest tier's blocks with the path from their root upwards and their tree's columns. roots: tree, path (that
    continues above the tree's root) and further columns of the tree."""
    extra = [c for c in roots.columns if c not in ("tree", "path")]
    blocks = None
    for t in reversed(tiers):
        ends = t.where(F.col("height") == F.col("b")).join(roots, "tree")
        inner = None if blocks is None else t.where(F.col("height") > F.col("b")).join(_child_paths(blocks, extra), ["tree", "block"])
        blocks = ends if inner is None else ends.unionByName(inner)
    return blocks


def _child_paths(blocks: DataFrame, extra: list[str]) -> DataFrame:
    """tree, block, path of each block below, with the tree's further columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                b, first, count, above = (one.column(c)[0].as_py() for c in ("b", "block", "count", "path"))
                nodes = np.frombuffer(one.column("nodes")[0].as_py(), np.uint8).reshape(-1, DIGEST)
                paths = [p + above for p in block_paths(nodes, b, count)]
                again = pa.array([0] * count)
                cols = [one.column("tree").take(again), pa.array(range(first * FAN**b, first * FAN**b + count), pa.int64()), pa.array(paths, pa.list_(pa.string())), *[one.column(c).take(again) for c in extra]]
                yield pa.RecordBatch.from_arrays(cols, names=["tree", "block", "path", *extra])

    kinds = dict(blocks.dtypes)
    need = blocks.select("tree", "b", "block", "count", "nodes", "path", *extra)
    return need.mapInArrow(work, "tree string, block long, path array<string>" + "".join(f", {c} {kinds[c]}" for c in extra))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root and verified for each row of docs.

    Leaves are made in the text's row; after that only ids and digests move: once to be put in order, once to their blocks.
    The proofs of a block's leaves are made in its task from its array and the path above its root."""
    leaves = materialize(dataset_leaves(docs), "merkle-leaves")
    ordered = numbered(leaves, "tree", ["doc_id", "digest"], "merkle-ordered")
    tiers = build_tiers(ordered, "merkle", carry=("doc_id", "tampered"))

    subroots = materialize(tree_roots(tiers), "merkle-subroots")
    sources = numbered(subroots.select(F.col("tree").alias("source_tree"), F.col("root").alias("digest"), F.lit("").alias("tree")), "tree", ["source_tree"], "merkle-sources")
    top = build_tiers(sources, "merkle-top", carry=("source_tree",))
    found = tree_roots(top).first()
    root = found["root"].hex() if found else ""
    start = docs.sparkSession.createDataFrame([("", [])], "tree string, path array<string>")
    above = _leaf_paths(block_paths_down(top, start)).join(subroots.withColumnRenamed("root", "subroot"), "tree")

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                tree, b, count, above, subroot, tampered = (one.column(c)[0].as_py() for c in ("tree", "b", "count", "path", "subroot", "tampered"))
                nodes = np.frombuffer(one.column("nodes")[0].as_py(), np.uint8).reshape(-1, DIGEST)
                leaf = nodes[_places(b + 1, b)[:count]].tobytes().hex()
                own = [leaf[2 * DIGEST * j : 2 * DIGEST * (j + 1)] for j in range(count)]
                rest, known, proofs, folded = "".join(above), {}, [], []
                for digest, other, path in zip(own, tampered, block_paths(nodes, b, count), strict=True):
                    proofs.append(hashlib.sha256(("".join(path) + rest).encode()).hexdigest())
                    top_of_block = fold(other.hex() if other is not None else digest, path)
                    if top_of_block not in known:
                        known[top_of_block] = fold(top_of_block, above)
                    folded.append(known[top_of_block])
                same = lambda v: pa.array([v] * count, pa.string())
                cols = [one.column("doc_id").flatten(), same(tree[1:] if tree else None), pa.array(own), same(subroot.hex()), same(root), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    rows = block_paths_down(tiers, above).select("tree", "b", "count", "nodes", "path", "subroot", "doc_id", "tampered")
    return rows.mapInArrow(work, schema)


def _leaf_paths(blocks: DataFrame) -> DataFrame:
    """tree (the carried name of each leaf) and its path."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                b, count, above = (one.column(c)[0].as_py() for c in ("b", "count", "path"))
                nodes = np.frombuffer(one.column("nodes")[0].as_py(), np.uint8).reshape(-1, DIGEST)
                paths = [p + above for p in block_paths(nodes, b, count)]
                yield pa.RecordBatch.from_arrays([one.column("source_tree").flatten(), pa.array(paths, pa.list_(pa.string()))], names=["tree", "path"])

    return blocks.select("b", "count", "nodes", "path", "source_tree").mapInArrow(work, "tree string, path array<string>")
