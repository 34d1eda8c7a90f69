"""N-gram Jaccard join by chosen paths: all links between texts whose sets of 5-word shingles have a similarity of 0.8 or more.

Equal word sequences are one class from the start; only its representative takes part, with the number of its copies.
A set is embedded as T MinHash positions (its tokens), so that the share of equal positions estimates the similarity.
Each of several independent runs splits all sets recursively: a node picks one or two positions by a hash of its path
(1 + EXTRA on average) and sends each set to the child named by the set's value there. Nodes of one set end; nodes of at
most LIMIT sets are compared by brute force; larger ones split on, and those that are still large at DEPTH are compared
in blocks of about LIMIT sets (fewer if they are long), a group for each pair of blocks. The number of runs follows from the
target recall of a pair of exactly the least similarity (by the recurrence of the splitting process, averaged over the
number of equal positions, which all runs share).

Comparison inside a bucket has two passes. The first reads MinHash bytes and set sizes only and names the members with
a likely partner; a pair counts in the least of its common buckets alone, so that no pair has to be sent anywhere to be
found unique. The second fetches the whole shingle sets of those members and verifies exactly. What leaves a task is
the number of links of each member and a spanning forest of the links, not the pairs; components are then found by
label propagation with pointer jumping over those edges.

Defined cases: null texts and texts without words have no links and are classes of their own; a text of fewer than five
words is one shingle; copies and repeated ids are rows of their own with their class; a class id is the least id of the
class (null if all are null); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import materialize, slices
from ragmill.session import ship

SHINGLE = 5
THRESHOLD = 0.8
T = 64
EXTRA = 0.25
DEPTH = 3
LIMIT = 1_024  # sets of a bucket or block
WEIGHT = 2_000_000  # shingles of a block
RECALL = 0.9995
SLACK = 0.22  # below the threshold, over four standard deviations of the estimate

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RNG = np.random.default_rng(20_240_607)
_A = _RNG.integers(1, 1 << 63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, T, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def recall_of_run(similarity: float, depth: int, extra: float = EXTRA) -> float:
    """Probability that a pair stays together on some path down to a depth."""
    r = 1.0
    for _ in range(depth):
        r = (1 - extra) * similarity * r + extra * (1 - (1 - similarity * r) ** 2)
    return r


def missed(similarity: float, runs: int, depth: int = DEPTH) -> float:
    """Probability that no run keeps a pair together down to a depth, or that the estimate refuses it. All runs share
    the T positions: the pair agrees in k of them (binomial), and given k the runs are independent."""
    need = int((THRESHOLD - SLACK) * T)
    out = 0.0
    for k in range(T + 1):
        weight = math.comb(T, k) * similarity**k * (1 - similarity) ** (T - k)
        out += weight * (1.0 if k < need else (1 - recall_of_run(k / T, depth)) ** runs)
    return out


def runs_for(recall: float, similarity: float = THRESHOLD, depth: int = DEPTH) -> int:
    runs = 1
    while missed(similarity, runs, depth) > 1 - recall:
        runs += 1
    return runs


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    return x


class Shingler:
    """Words of a text, their shingle set (sorted 64-bit hashes) and the MinHash positions of a set."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.cache = width, {}

    def words(self, text: str) -> list[bytes]:
        return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())

    def shingles(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        if len(cache) > 500_000:
            cache.clear()
        h = []
        for w in words:
            if (x := cache.get(w)) is None:
                x = cache[w] = xxhash.xxh3_64_intdigest(w)
            h.append(x)
        v = np.array(h, dtype=np.uint64)
        k = min(self.width, len(v))
        s = v[: len(v) - k + 1].copy()
        for i in range(1, k):
            s = _mix(s * _P + v[i : len(v) - k + 1 + i])
        return np.unique(s)

    def minhash(self, s: np.ndarray) -> np.ndarray:
        out = np.empty(T, dtype=np.uint64)
        for i in range(T):
            out[i] = (s * _A[i] + _B[i]).min()
        return (out >> np.uint64(32)).astype(np.uint32)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sh = Shingler()
    for b in slices(batches):
        keys, sizes, sigs = [], [], []
        rest = [c for c in b.schema.names if c != "_text"]
        for text in b.column("_text").to_pylist():
            words = sh.words(text or "")
            if not words:
                keys.append(None)
                sizes.append(0)
                sigs.append(None)
                continue
            s = sh.shingles(words)
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sizes.append(len(s))
            sigs.append(sh.minhash(s).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], names=[*rest, "key", "n", "sig"])


def _h(*parts: int) -> int:
    return xxhash.xxh3_64_intdigest(b"".join((p & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little") for p in parts))


def _positions(node: int) -> list[int]:
    """The one or two positions that a node picks."""
    x = _h(node, 1)
    got = [x % T]
    if (x >> 32) % 1_000 < EXTRA * 1_000:
        got.append((got[0] + 1 + (x >> 44) % (T - 1)) % T)
    return got


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _split(first: bool, runs: int):
    """Rows (node, key) of the children of each set's node; of all runs' roots if first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = [_h(r, 7) for r in range(runs)]
        picks: dict[int, list[int]] = {}
        for b in batches:
            nodes, keys = [], []
            parents = [roots] * b.num_rows if first else [[n & 0xFFFFFFFFFFFFFFFF] for n in b.column("node").to_pylist()]
            for key, sig, mine in zip(b.column("key").to_pylist(), b.column("sig").to_pylist(), parents, strict=True):
                v = np.frombuffer(sig, dtype=np.uint32)
                for p in mine:
                    if (at := picks.get(p)) is None:
                        if len(picks) > 100_000:
                            picks.clear()
                        at = picks[p] = _positions(p)
                    for i in at:
                        nodes.append(_signed(_h(p, i, int(v[i]))))
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(keys, pa.binary())], names=["node", "key"])

    return work


def buckets(reps: DataFrame, runs: int, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """Rows (node, key, size, weight) of the buckets to compare: nodes of two or more sets that are small, or at full
    depth; size and weight are the bucket's sets and shingles."""
    sizes_of = reps.select("key", "n")
    rows = reps.select("key", "sig").mapInArrow(_split(True, runs), "node long, key binary")
    done: DataFrame | None = None
    for level in range(1, depth + 1):
        rows = materialize(rows, f"jaccard-level{level}")
        sizes = rows.join(sizes_of, "key").groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where(F.col("size") > 1)
        rows = rows.join(sizes, "node")
        last = level == depth
        leaf = rows if last else rows.where(F.col("size") <= limit)
        done = leaf if done is None else done.unionByName(leaf)
        if last:
            break
        large = rows.where(F.col("size") > limit).select("node", "key")
        rows = large.join(reps.select("key", "sig"), "key").mapInArrow(_split(False, runs), "node long, key binary")
    return done


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Consecutive rows of equal (node, bi, bj) as columns of lists; a group is at most two blocks."""
    now, rows = None, {}
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in b.schema.names}
        for i, g in enumerate(zip(cols["node"], cols["bi"], cols["bj"], strict=True)):
            if g != now:
                if now is not None:
                    yield rows
                now, rows = g, {c: [] for c in cols}
            for c, v in cols.items():
                rows[c].append(v[i])
    if now is not None:
        yield rows


def _likely(g: dict[str, list], threshold: float) -> np.ndarray:
    """Index pairs (a < b) of a bucket that are likely to be similar and count in this bucket."""
    n = len(g["key"])
    sig = np.frombuffer(b"".join(g["sig8"]), dtype=np.uint8).reshape(n, T)
    size = np.array(g["n"], dtype=np.float64)
    block = np.array(g["blk"])
    one = g["bi"][0] == g["bj"][0]
    order = {k: i for i, k in enumerate(sorted(set(g["key"])))}
    rank = np.array([order[k] for k in g["key"]])
    need = int((threshold - SLACK) * T)
    found = []
    for i in range(n):
        ok = (sig == sig[i]).sum(1) >= need
        ok &= (np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i])) & (rank > rank[i])
        if not one:
            ok &= block != block[i]
        j = np.flatnonzero(ok)
        if len(j):
            found.append(np.stack([np.full(len(j), i), j], 1))
    if not found:
        return np.zeros((0, 2), dtype=np.int64)
    pairs = np.concatenate(found)
    node = g["node"][0]
    lists = [np.array(x, dtype=np.int64) for x in g["nodes"]]
    width = max(map(len, lists))
    top = np.iinfo(np.int64).max
    pad = np.full((n, width), top)
    for i, x in enumerate(lists):
        pad[i, : len(x)] = x
    keep = []
    for at in range(0, len(pairs), 4_096):
        p = pairs[at : at + 4_096]
        a, b = pad[p[:, 0]], pad[p[:, 1]]
        shared = (a[:, :, None] == b[:, None, :]).any(2)
        keep.append(np.where(shared, a, top).min(1) == node)
    return pairs[np.concatenate(keep)]


def _active(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            p = _likely(g, threshold)
            if len(p):
                i = np.unique(p)
                yield pa.RecordBatch.from_arrays([pa.array([g[c][k] for k in i], t) for c, t in (("node", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("blk", pa.int32()), ("key", pa.binary()))], names=["node", "bi", "bj", "blk", "key"])

    return work


def _verify(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            pairs = _likely(g, threshold)
            sets = [np.frombuffer(s, dtype=np.uint64) for s in g["shingles"]]
            links, root = [0] * len(sets), list(range(len(sets)))
            edges: list[tuple[int, int]] = []

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in pairs.tolist():
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a] += g["copies"][b]
                    links[b] += g["copies"][a]
                    if (x := find(a)) != (y := find(b)):
                        root[y] = x
                        edges.append((a, b))
            key = g["key"]
            out = [(key[i], None, n) for i, n in enumerate(links) if n] + [(key[a], key[b], 0) for a, b in edges]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int64())], names=["key", "other", "links"])

    return work


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sh = Shingler()
    for b in slices(batches):
        keys, sets = [], []
        for text in b.column("_text").to_pylist():
            words = sh.words(text or "")
            keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sets.append(sh.shingles(words).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """key, label: the least key of each connected component of edges (key, other); keys without edges are absent."""
    both = materialize(edges.select("key", "other").unionByName(edges.select(F.col("other").alias("key"), F.col("key").alias("other"))).distinct(), "jaccard-edges")
    labels = materialize(both.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("label")), "jaccard-labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("other"), "label"), "other").groupBy("key").agg(F.min("label").alias("m"))
        step = labels.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("up"))
        new = materialize(step.join(jump, "label", "left").select("key", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "jaccard-labels")
        labels = new.select("key", "label")
        if new.where(F.col("was") != F.col("label")).isEmpty():
            return labels


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, row_key: str | None = None) -> DataFrame:
    """One row per input row: id, class_id (least id of its near-duplicate component), copy_id (least id of the texts of
    the same words) and n_links (other rows with a similarity of at least the threshold). row_key names a narrow column
    to carry along; then class_key, which is the same in all rows of a class and null for texts without words, comes too."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_tk"), *([F.col(row_key).alias("_rk")] if row_key else []), F.col(text_col).alias("_text"))
    carried = ", ".join(f"{c} {k}" for c, k in src.dtypes if c != "_text")
    rows = materialize(src.mapInArrow(_profile, f"{carried}, key binary, n int, sig binary"), "jaccard-profiles")
    known = rows.where(F.col("key").isNotNull())
    reps = materialize(known.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("_id").isNull(), "_id", "_tk")).alias("f"), F.max("n").alias("n"), F.max("sig").alias("sig")).select("key", "copies", F.col("f._id").alias("copy_id"), F.col("f._tk").alias("_tk"), "n", "sig"), "jaccard-reps")
    runs = runs_for(recall, threshold)
    found = materialize(buckets(reps, runs), "jaccard-buckets")
    lists = found.groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("nodes"))  # at most (1 + EXTRA)^DEPTH a run
    profile = reps.join(lists, "key").select("key", "n", "copies", "_tk", "copy_id", "nodes", F.expr("unhex(array_join(transform(sequence(1, 253, 4), i -> hex(substring(sig, i, 1))), ''))").alias("sig8"))
    profile = materialize(profile, "jaccard-members")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / LIMIT), F.ceil(F.col("weight") / WEIGHT)).cast("int")
    split = found.distinct().withColumn("_nb", n_blocks).withColumn("blk", F.pmod(F.xxhash64("key"), F.col("_nb")).cast("int"))
    split = split.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))  # each block meets each other once
    split = split.select("node", F.least("blk", "_c").alias("bi"), F.greatest("blk", "_c").alias("bj"), "blk", "key")
    by = ["node", "bi", "bj"]
    first = split.join(profile.select("key", "n", "nodes", "sig8"), "key").repartition(*by).sortWithinPartitions(*by)
    active = materialize(first.mapInArrow(_active(threshold), "node long, bi int, bj int, blk int, key binary"), "jaccard-active")
    wanted = profile.join(active.select("key").distinct(), "key", "left_semi")
    # one text of each class, by id and digest; merged at every size, as the wanted ids grow with the input
    ident = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    texts = docs.select(F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("_tk"), ident(id_col).alias("_i"))
    texts = texts.join(wanted.select("_tk", ident("copy_id").alias("_i")).hint("merge"), ["_tk", "_i"], "left_semi").select("_text")
    sets = texts.mapInArrow(_shingle_sets, "key binary, shingles binary").groupBy("key").agg(F.max("shingles").alias("shingles"))
    full = active.join(wanted.join(sets, "key").select("key", "n", "copies", "nodes", "sig8", "shingles"), "key").repartition(*by).sortWithinPartitions(*by)
    linked = materialize(full.mapInArrow(_verify(threshold), "key binary, other binary, links long"), "jaccard-links")
    links = linked.where(F.col("other").isNull()).groupBy("key").agg(F.sum("links").alias("links"))
    labels = components(linked.where(F.col("other").isNotNull()))
    ids = labels.join(reps.select("key", "copy_id"), "key")
    classes = ids.join(ids.groupBy("label").agg(F.min("copy_id").alias("class_id")), "label").select("key", "label", "class_id")
    per_rep = reps.select("key", "copies", "copy_id").join(links, "key", "left").join(classes, "key", "left")
    per_rep = per_rep.select("key", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("label", "key").alias("class_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # written, so that the join with the rows is between two exchanges and a hot text's rows can be dealt over tasks
    per_rep = materialize(per_rep, "jaccard-classes")
    out = rows.select("_id", *(["_rk"] if row_key else []), "key").join(per_rep, "key", "left")
    alone = F.col("key").isNull()
    cols = [F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    return out.select(*cols, *([F.col("_rk").alias(row_key), "class_key"] if row_key else []))
