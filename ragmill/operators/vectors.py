"""Embeddings, cosine search and near-duplicate documents."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.tokens import Tokens, tokens
from ragmill.session import ship, written

DIM = 512
NEAR = 0.92
BLOCK = 512
#: Bytes of one block of vectors in a search.
BLOCK_BYTES = 1 << 20


def bucket(token: Column) -> Column:
    """Dimension of a token: md5 modulo 512; its sign is + in the upper half of the dimensions, else -."""
    return F.conv(F.right(F.md5(token), F.lit(3)), 16, 10).cast("int") % DIM


def embed_array(texts: pd.Series) -> pd.Series:
    """Signed token hashing to DIM numbers with L2 norm 1; the zero vector stays."""
    out: list[np.ndarray] = []
    for at in range(0, len(texts), 512):
        out.extend(embed_tokens(tokens(texts.iloc[at : at + 512].to_list())))
    return pd.Series(out)


#: Dimensions of tokens that this process has met.
_BUCKETS: dict[bytes, int] = {}
_MOST_TOKENS = 1_000_000


def embed_tokens(found: Tokens) -> np.ndarray:
    """Vectors of tokenised texts, a row each."""
    if len(_BUCKETS) > _MOST_TOKENS:
        _BUCKETS.clear()
    for w in found.terms:
        if w not in _BUCKETS:
            _BUCKETS[w] = int(hashlib.md5(w).hexdigest()[-3:], 16) % DIM
    at = np.array([_BUCKETS[w] for w in found.terms], dtype=np.int64)[found.codes]
    m = np.bincount(found.rows * DIM + at, minlength=found.texts * DIM).reshape(found.texts, DIM).astype(float)
    m[:, : DIM // 2] *= -1
    return unit_rows(m + 0.0)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows with L2 norm 1; zero rows stay."""
    norm = np.sqrt((m * m).sum(1))[:, None]
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def hash_embed(df: DataFrame, text: str = "content", out: str = "embedding", embedder: Callable[[pd.Series], pd.Series] = embed_array) -> DataFrame:
    """Add the vector of each text. `embedder` maps a batch of texts to as many vectors in the same order (any model that
    runs in a task); the default hashes tokens. A batch with another number of vectors is an error."""
    ship(df.sparkSession)

    def embed(texts: pd.Series) -> pd.Series:
        vectors = embedder(texts)
        if len(vectors) != len(texts):
            raise ValueError(f"embedder gave {len(vectors)} vectors for {len(texts)} texts")
        return pd.Series(list(vectors), index=texts.index)

    return df.withColumn(out, F.pandas_udf(embed, "array<double>")(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def _packed(rows: DataFrame, id_col: str, hidden: str) -> DataFrame:
    """Rows (group, id_col, embedding) as blocks of one group and dimension: group, dim, ids and the matrix' bytes. A block
    is filled where its rows lie, without a shuffle, and holds at most BLOCK_BYTES; zero vectors keep their place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[tuple, tuple[list[int], list[np.ndarray]]] = {}
        held = 0

        def closed(key: tuple) -> pa.RecordBatch:
            ids, parts = open_blocks.pop(key)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], group_type), pa.array([key[1]], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.stack(parts).tobytes()])], names=["group", "dim", hidden, f"{hidden}_m"])

        for b in batches:
            group_type = b.schema.field("group").type
            vecs = b.column("embedding")
            flat, ends = vecs.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.nan_to_num(pa.compute.list_value_length(vecs).to_numpy(zero_copy_only=False)))]).astype(int)
            for i, (g, x) in enumerate(zip(b.column("group").to_pylist(), b.column(id_col).to_pylist(), strict=True)):
                dim = int(ends[i + 1] - ends[i])
                if not dim:
                    continue
                ids, parts = open_blocks.setdefault((g, dim), ([], []))
                ids.append(x)
                parts.append(flat[ends[i] : ends[i + 1]].copy())
                held += dim * 8
                if len(ids) * dim * 8 >= BLOCK_BYTES:
                    held -= len(ids) * dim * 8
                    yield closed((g, dim))
            if held > 64 * BLOCK_BYTES:  # many small groups
                for key in list(open_blocks):
                    yield closed(key)
                held = 0
        for key in list(open_blocks):
            yield closed(key)

    kind = dict(rows.dtypes)["group"]
    flat = rows.select("group", id_col, F.col("embedding").cast("array<double>").alias("embedding"))
    return flat.mapInArrow(work, f"group {kind}, dim int, {hidden} array<long>, {hidden}_m binary")


def best_of(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest similarities; ties: the larger id first."""
    at = np.arange(len(ids))
    if len(ids) > k:
        least = np.partition(sims, len(ids) - k)[len(ids) - k]
        at = np.flatnonzero(sims >= least)
    return at[np.lexsort((-ids[at], -sims[at]))[:k]]


def _scored(k: int):
    """Top k of each query over the pairs of blocks of a task: merged in the task, written out when they become many."""

    def unit(ids: list[int], raw: bytes) -> np.ndarray:
        return unit_rows(np.frombuffer(raw).reshape(len(ids), -1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def closed() -> pa.RecordBatch:
            cols = [np.repeat(list(best), [len(i) for i, _ in best.values()]), np.concatenate([i for i, _ in best.values()]), np.concatenate([s for _, s in best.values()])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "similarity"])

        for b in batches:
            for i in range(b.num_rows):
                qs, ids = b.column("qs")[i].as_py(), b.column("vs")[i].as_py()
                q, ids = unit(qs, b.column("qs_m")[i].as_py()), np.array(ids)
                sims = np.round(q @ unit(ids, b.column("vs_m")[i].as_py()).T, 9)
                for j, name in enumerate(qs):
                    if not q[j].any():
                        continue
                    mine, near = ids, sims[j]
                    if name in best:
                        mine, near = np.concatenate([best[name][0], ids]), np.concatenate([best[name][1], near])
                    at = best_of(mine, near, k)
                    best[name] = (mine[at], near[at])
                if len(best) * k > 1 << 20:
                    yield closed()
                    best.clear()
        if best:
            yield closed()

    return work


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, by_group: bool = True) -> DataFrame:
    """Top k vectors by cosine of each query: query_id, id, similarity, rank (ties: the larger id first).

    vectors: group, id, embedding; queries: query_id, group, embedding; a query sees its group (or all). Both sides become
    blocks of one group and dimension of a fixed size in bytes: vectors where they lie, queries dealt by group and number, so
    that a hot group has many blocks. Blocks meet in one join (the queries' side is broadcast where its size is below Spark's
    threshold, else both are shuffled and skewed groups split); a task multiplies pair after pair and keeps k a query, and
    these are merged by a window that is limited in each task first. Vectors of another dimension and zero queries match
    nothing."""
    ship(vectors.sparkSession)
    group = F.col("group") if by_group else F.lit(0)
    q = queries.select(group.alias("group"), "query_id", "embedding").where(F.size("embedding") > 0)
    q = q.withColumn("_dim", F.size("embedding"))
    rows = F.lit(float(BLOCK_BYTES // 8)) / F.col("_dim")
    sizes = q.groupBy("group", "_dim").agg(F.count("*").alias("_n")).withColumn("_nb", F.ceil(F.col("_n") / rows))
    dealt = q.join(sizes, ["group", "_dim"]).withColumn("_b", F.pmod(F.xxhash64("query_id"), F.col("_nb")))
    asked = written(_packed(dealt.repartition("group", "_dim", "_b").select("group", "query_id", "embedding"), "query_id", "qs"), "query-blocks")
    blocks = _packed(vectors.select(group.alias("group"), "id", "embedding"), "id", "vs")
    found = blocks.join(asked, ["group", "dim"]).select("qs", "qs_m", "vs", "vs_m").mapInArrow(_scored(k), "query_id long, id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id").desc())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


@dataclass
class Lists:
    """Inverted lists: vectors with their list (written), the centroids, and the number of lists to probe."""

    vectors: DataFrame
    centres: np.ndarray
    probes: int


def _nearest(centres: np.ndarray, count: int):
    """Arrow function: the `count` nearest lists of each vector, nearest first."""

    def near(embeddings: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(e, dtype=np.float64) for e in embeddings])
        norm = np.sqrt((m * m).sum(1))[:, None]
        order = np.argsort(-(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0) @ centres.T), axis=1, kind="stable")
        return pd.Series(list(order[:, :count].astype(np.int32)))

    return F.pandas_udf(near, "array<int>")


def coarse_centres(vectors: DataFrame, lists: int, sample: int, turns: int = 10) -> np.ndarray:
    """Unit centroids of `lists` clusters of directions, fitted on the `sample` vectors of smallest hashed id."""
    chosen = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    m = np.array([r["embedding"] for r in chosen], dtype=np.float64)
    if not len(m):
        return np.zeros((0, 0))
    norm = np.sqrt((m * m).sum(1))
    m = m[norm > 0] / norm[norm > 0, None]
    centres = m[:lists].copy()
    for _ in range(turns):
        mine = (m @ centres.T).argmax(1)
        for j in range(len(centres)):
            if (total := m[mine == j].sum(0)).any():
                centres[j] = total / np.sqrt(total @ total)
    return centres


def inverted_lists(vectors: DataFrame, k: int = 8, target: float = 0.95, sample: int = 20_000, tried: int = 64, most: int = 1_024) -> Lists:
    """Lists over vectors (id, embedding of one dimension): about the root of their number, at most `most`. Centroids come from
    a bounded sample, but every row is assigned. The number of probes is measured: the true top k of `tried` vectors lie
    in lists whose order for these vectors is known, so one exact search tells the recall of every number of probes."""
    ship(vectors.sparkSession)
    rows = vectors.where(F.size("embedding") > 0).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    centres = coarse_centres(rows, max(1, min(most, math.isqrt(n))), sample)
    stored = written(rows.withColumn("list", _nearest(centres, 1)("embedding")[0]), "inverted-lists")
    if not n:
        return Lists(stored, centres, 0)
    asked = written(stored.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(tried).withColumn("order", _nearest(centres, len(centres))("embedding")), "recall-queries")
    exact = dense_topk(stored.withColumn("group", F.lit(0)), asked.select(F.col("id").alias("query_id"), F.lit(0).alias("group"), "embedding"), k)
    place = exact.join(stored.select("id", "list"), "id").join(asked.select(F.col("id").alias("query_id"), "order"), "query_id").select(F.array_position("order", F.col("list")).alias("p"))
    seen = np.sort([r["p"] for r in place.collect()])  # tried * k numbers
    return Lists(stored, centres, int(seen[math.ceil(target * len(seen)) - 1]))


def ann_candidates(vectors: DataFrame | Lists, queries: DataFrame, k: int) -> DataFrame:
    """Approximate top k: each query searches its nearest inverted lists only, by exact cosine. Columns as dense_topk."""
    lists = vectors if isinstance(vectors, Lists) else inverted_lists(vectors, k)
    asked = queries.where(F.size("embedding") > 0).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.withColumn("group", F.explode(_nearest(lists.centres, lists.probes)("embedding")))
    return dense_topk(lists.vectors.select("id", F.col("list").alias("group"), "embedding"), asked, k)


def doc_centroid(chunks: DataFrame, first: int = 10) -> DataFrame:
    """Mean of a document's first chunk vectors: document_id, dim, centroid. Vectors of another length than the first are
    left out."""
    head = chunks.where(F.col("chunk_index") < first).select("document_id", "chunk_index", "embedding")
    few = head.where(F.size("embedding") > 0).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "embedding"))).alias("v"))  # at most `first`
    few = few.withColumn("dim", F.size(F.col("v")[0]["embedding"])).withColumn("v", F.filter(F.transform("v", lambda x: x["embedding"].cast("array<double>")), lambda x: F.size(x) == F.col("dim")))
    total = F.aggregate("v", F.array_repeat(F.lit(0.0), F.col("dim")), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return few.select("document_id", "dim", F.transform(total, lambda t: t / F.size("v")).alias("centroid"))


def text_centroids(docs: DataFrame, text: str, cut: Callable[[str | None], list[str]], embedder: Callable[[pd.Series], pd.Series] = embed_array) -> DataFrame:
    """The other columns of docs with dim and centroid, the mean vector of what `cut` makes of a text, say its first chunks:
    doc_centroid without a row for each vector. Documents without a part are left out."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                parts = [cut(t) for t in b.column(text).to_pylist()]
                b = b.filter(pa.array([bool(x) for x in parts]))
                parts = [x for x in parts if x]
                if not parts:
                    continue
                vecs = embedder(pd.Series([t for x in parts for t in x], dtype=object)).to_list()
                ends = np.cumsum([0, *map(len, parts)])
                means = [np.sum(np.stack(vecs[i:j]), axis=0, dtype=float) / (j - i) for i, j in zip(ends, ends[1:], strict=False)]
                kept = [c for c in b.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array([len(m) for m in means], pa.int32()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, means)]), pa.int32()), pa.array(np.concatenate(means)))], names=[*kept, "dim", "centroid"])

    kept = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes if c != text)
    return docs.mapInArrow(work, f"{kept}, dim int, centroid array<double>")


#: Bytes of the packed vectors that one task holds while others pass by, but for up to TILES tiles of a user it may hold less;
#: cells of a large user.
TILE_BYTES, LEAST_BYTES, TILES, CELLS = 64 << 20, 512 << 10, 12, 16


def _near_blocks(docs: DataFrame, block: int, centres: np.ndarray | None) -> DataFrame:
    """Documents (user_id, document_id, created_at, dim, centroid) as blocks of one user and dimension, in time order, with
    compressed unit vectors. A user of more than 4 blocks has blocks of one cell (nearest centre) each, so that blocks of
    other directions can be passed over. Rows: user_id, dim, b (number), docs, times, m, tiles (how many TILE_BYTES the user fills)."""
    big = 4 * block

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        counts: dict[tuple, int] = {}
        rows = 0

        def closed(key: tuple) -> pa.RecordBatch:
            nonlocal rows
            ids, at, m = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            rows -= counts.pop(key)
            order = np.lexsort((ids, at))
            raw = pa.compress(np.ascontiguousarray(unit_rows(m[order])).tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], user_type), pa.array([key[1]], pa.int32()), pa.array([ids[order]], pa.list_(pa.int64())), pa.array([at[order]], pa.list_(pa.int64())), pa.array([raw], pa.binary())], names=["user_id", "dim", "docs", "times", "m"])

        for batch in batches:
            user_type = batch.schema.field("user_id").type
            users, dims, many = (batch.column(c).to_pylist() for c in ("user_id", "dim", "_n"))
            ids, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("document_id", "at"))
            vecs = batch.column("centroid")
            flat, ends = vecs.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)]).astype(int)
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(users, dims, many, strict=True)):
                groups.setdefault(key, []).append(i)
            for (user, dim, n), at_rows in groups.items():
                m = np.stack([flat[ends[i] : ends[i + 1]] for i in at_rows])
                cell = (m @ centres.T).argmax(1) if centres is not None and n > big and dim == centres.shape[1] else np.zeros(len(m), int)
                for c in np.unique(cell):
                    key, mine = (user, dim, int(c)), np.flatnonzero(cell == c)
                    for part in np.array_split(mine, -(-len(mine) // block)):
                        if counts.get(key, 0) + len(part) > block:
                            yield closed(key)
                        picked = np.array(at_rows)[part]
                        held.setdefault(key, []).append((ids[picked], at[picked], m[part]))
                        counts[key] = counts.get(key, 0) + len(part)
                        rows += len(part)
            if rows > CELLS * block:  # many small users or cells
                for key in list(held):
                    yield closed(key)
        for key in list(held):
            yield closed(key)

    kind = dict(docs.dtypes)["user_id"]
    sizes = docs.groupBy("user_id", "dim").agg(F.count("*").alias("_n"))
    rows = docs.join(sizes, ["user_id", "dim"]).withColumn("_s", F.pmod(F.xxhash64("document_id"), F.ceil(F.col("_n") / (CELLS * block))))
    rows = rows.select("user_id", "dim", "_n", "_s", "document_id", F.unix_micros("created_at").alias("at"), F.col("centroid").cast("array<double>").alias("centroid")).repartition("user_id", "dim", "_s").drop("_s")
    packed = written(rows.mapInArrow(work, f"user_id {kind}, dim int, docs array<long>, times array<long>, m binary").withColumn("b", F.monotonically_increasing_id()), "near-blocks")
    size = F.sum(F.octet_length("m"))
    tiles = packed.groupBy("user_id", "dim").agg(F.greatest(F.ceil(size / TILE_BYTES), F.least(F.lit(TILES), F.ceil(size / LEAST_BYTES))).cast("int").alias("tiles"))
    return packed.join(tiles, ["user_id", "dim"])


def _near(threshold: float, centres: np.ndarray | None, mutual: bool):
    """Over pairs of blocks: for each document of the first block the earliest match in the second (with `mutual` an earlier
    one, and the same the other way). Single precision only screens, with a margin beyond its error; what it lets through is
    decided in double precision. Vectors whose angles to a centre differ by more than the threshold's angle can't match."""
    apart = np.arccos(threshold) + 1e-6 if 0 < threshold < 1 else None

    class Block:
        def __init__(self, docs: list[int], times: list[int], raw: bytes, dim: int) -> None:
            self.docs, self.times = np.array(docs), np.array(times)
            self.m = np.frombuffer(pa.decompress(raw, decompressed_size=len(docs) * dim * 8, codec="zstd", asbytes=True)).reshape(-1, dim)
            self.small = self.m.astype(np.float32)
            self.angles = np.arccos(np.clip(self.m @ centres.T, -1, 1)) if apart and centres is not None and dim == centres.shape[1] else None

        def near(self, other: Block, chosen: np.ndarray) -> np.ndarray:
            """Rows that may match some of the other's chosen rows."""
            if self.angles is None or not len(chosen):
                return np.arange(len(self.docs))
            theirs = other.angles[chosen]
            return np.flatnonzero(((self.angles >= theirs.min(0) - apart) & (self.angles <= theirs.max(0) + apart)).all(1))

    def firsts(hit: np.ndarray, left: Block, right: Block, rows: np.ndarray, cols: np.ndarray):
        """For each of the left rows its first match among the right columns, both in time order; hit is used up."""
        alive = np.flatnonzero(hit.any(1))
        while len(alive):
            first = hit[alive].argmax(1)
            i, j = rows[alive], cols[first]
            sim = np.round(np.einsum("ij,ij->i", left.m[i], right.m[j]), 12)
            ok = sim > threshold
            if mutual:
                earlier = (right.times[j] < left.times[i]) | ((right.times[j] == left.times[i]) & (right.docs[j] < left.docs[i]))
                yield left.docs[i[ok & earlier]], right.docs[j[ok & earlier]], right.times[j[ok & earlier]], sim[ok & earlier]
                ok = ok | ~earlier  # all others come later still
            else:
                yield left.docs[i[ok]], right.docs[j[ok]], right.times[j[ok]], sim[ok]
            hit[alive[~ok], first[~ok]] = False
            alive = alive[~ok]
            alive = alive[hit[alive].any(1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int, float]] = {}

        def closed() -> pa.RecordBatch:
            d = pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), *[pa.array([x[k] for x in best.values()], t) for k, t in ((1, pa.int64()), (0, pa.int64()), (2, pa.float64()))]], names=["document_id", "duplicate_of", "at", "similarity"])
            best.clear()
            return d

        kept: dict[int, Block] = {}  # the last block of the passing side
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r].as_py() for c in ("dim", "b1", "b2")}
                load = lambda n, one=one, r=r, batch=batch: Block(*(batch.column(f"{c}{n}")[r].as_py() for c in ("docs", "times", "m")), one["dim"])
                if one["b1"] not in kept:
                    kept = {one["b1"]: load(1)}
                left = kept[one["b1"]]
                right = left if mutual and one["b1"] == one["b2"] else load(2)
                cols = right.near(left, np.arange(len(left.docs)))
                rows = left.near(right, cols)
                cols = right.near(left, rows)
                if not len(rows) or not len(cols):
                    continue
                margin = (one["dim"] + 8) * 1.2e-7
                hit = left.small[rows] @ right.small[cols].T > threshold - margin
                found = list(firsts(hit.copy() if mutual and right is not left else hit, left, right, rows, cols))
                if mutual and right is not left:
                    found += firsts(np.ascontiguousarray(hit.T), right, left, cols, rows)
                for part in found:
                    for doc, other, at, sim in zip(*(x.tolist() for x in part), strict=True):
                        if doc not in best or (at, other) < best[doc][:2]:
                            best[doc] = (at, other, sim)
                if len(best) > 1 << 17:
                    yield closed()
        if best:
            yield closed()

    return work


def _pairs_of_blocks(passing: DataFrame, staying: DataFrame, threshold: float, centres: np.ndarray | None, mutual: bool) -> DataFrame:
    """The blocks that stay are dealt to tiles of their user that fit a task; those that pass go to each tile of the user
    (with `mutual` to half of them, so that every pair meets once) and meet what stays there one by one."""
    key, tile = ["user_id", "dim", "tile"], lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    stays = staying.select("user_id", "dim", tile("tiles").alias("tile"), F.col("b").alias("b2"), F.col("docs").alias("docs2"), F.col("times").alias("times2"), F.col("m").alias("m2"))
    if mutual:  # a ring: each tile takes what belongs to it and to half of the others
        step = F.explode(F.sequence(F.lit(0), F.floor(F.col("tiles") / 2).cast("int")))
        passes = passing.withColumn("own", tile("tiles")).withColumn("step", step).where((2 * F.col("step") != F.col("tiles")) | (2 * F.col("own") < F.col("tiles"))).withColumn("tile", (F.col("own") + F.col("step")) % F.col("tiles"))
    else:
        most = staying.select("user_id", "dim", F.col("tiles").alias("_t")).distinct()
        passes = passing.join(most, ["user_id", "dim"]).withColumn("step", F.lit(1)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    passes = passes.select(*key, "step", F.col("b").alias("b1"), F.col("docs").alias("docs1"), F.col("times").alias("times1"), F.col("m").alias("m1"))
    met = passes.join(stays.hint("shuffle_hash"), key).where((F.col("step") > 0) | (F.col("b1") <= F.col("b2")))
    found = met.select("dim", "b1", "docs1", "times1", "m1", "b2", "docs2", "times2", "m2").mapInArrow(_near(threshold, centres, mutual), "document_id long, duplicate_of long, at long, similarity double")
    best = found.groupBy("document_id").agg(F.min(F.struct("at", "duplicate_of", "similarity")).alias("b"))
    return best.select("document_id", "b.duplicate_of", F.round("b.similarity", 6).alias("similarity"))


def _cell_centres(docs: DataFrame, block: int) -> np.ndarray | None:
    """Centres of the cells from a small sample; they only steer what is passed over, every vector is compared or ruled out."""
    most = docs.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    if most is None or most["n"] <= 4 * block:
        return None
    few = F.pmod(F.xxhash64("document_id"), F.lit(max(1, most["n"] // 2_000))) == 0  # else each task would send 2,000 vectors to the driver
    centres = coarse_centres(docs.where((F.col("dim") == most["dim"]) & few).select(F.col("document_id").alias("id"), F.col("centroid").alias("embedding")), CELLS, 2_000)
    return centres if len(centres) else None


def near_duplicates(docs: DataFrame, threshold: float = NEAR, block: int = 4 * BLOCK) -> DataFrame:
    """For each document the earliest earlier one of its user with a centroid cosine above the threshold.

    docs: user_id, document_id, created_at, dim, centroid. A user's documents become blocks; each pair of blocks meets once,
    in tasks that hold a bounded tile of blocks while the others pass by, so a large user is spread over many tasks and its
    vectors are copied once for each tile, not for each block."""
    ship(docs.sparkSession)
    docs = written(docs.select("user_id", "document_id", "created_at", "dim", "centroid"), "near-centroids")
    centres = _cell_centres(docs, block)
    blocks = _near_blocks(docs, block, centres)
    return _pairs_of_blocks(blocks, blocks, threshold, centres, True)


def duplicates_of_new(new: DataFrame, stored: DataFrame, threshold: float = NEAR, block: int = 4 * BLOCK) -> DataFrame:
    """For each new document the earliest stored one of its user with a centroid cosine above the threshold.

    Both: user_id, document_id, created_at, dim, centroid. Blocks of the new documents pass by the tiles of the stored ones
    of their user. Only a row for each new document that has a match is returned."""
    ship(new.sparkSession)
    cols = ["user_id", "document_id", "created_at", "dim", "centroid"]
    new, stored = written(new.select(*cols), "near-new"), written(stored.select(*cols), "near-stored")
    centres = _cell_centres(stored, block)
    return _pairs_of_blocks(_near_blocks(new, block, centres), _near_blocks(stored, block, centres), threshold, centres, False)


def similar_pairs(vectors: DataFrame, by: str, threshold: float) -> DataFrame:
    """Pairs of one group's few vectors (a query's results) with a cosine above the threshold: by, a, b, weight."""
    a = vectors.select(by, F.col("pos").alias("a"), F.col("embedding").alias("va"))
    b = vectors.select(by, F.col("pos").alias("b"), F.col("embedding").alias("vb"))
    p = a.join(b, by).where((F.col("a") < F.col("b")) & (F.size("va") == F.size("vb")))
    return p.withColumn("weight", F.round(cosine(F.col("va"), F.col("vb")), 4)).where(F.col("weight") > threshold).select(by, "a", "b", "weight")
