"""Language-model scoring with a probabilistic suffix tree over the bytes of a text's words.

Symbols: the end of a text, the 59 most frequent bytes of the training words (a space stands between words), and for each
other byte an escape and a second symbol, so that every byte is scored in its context. All contexts of up to DEPTH
symbols are counted. A context is a state if the training texts have it MIN_COUNT times, whatever their size, and if its
next-symbol distribution diverges from that of its longest proper suffix by more than one nat for each of its own
parameters; the suffixes of a state are states. Each state's distribution is smoothed towards that of its parent. A
text's symbol is scored by the longest state that is a suffix of what stands before it.

States and scores stay tables: the counts of each depth, its states and the probability of each (context, symbol) pair
that any text has are joined by key, a depth at a time, so nothing limits the number of states. Of the pairs (and
words) only those of a share of at least HEAD_SHARE (WORD_SHARE), at most 1 / HEAD_SHARE (1 / WORD_SHARE), are broadcast;
a text's other pairs and words meet their scores in a join.

Defined cases: a null text is empty (one end symbol and token); without training texts every context is the uniform
distribution and no token is known; repeated ids and copies give a row each; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.llm.common import bucket_of, materialize, slices
from ragmill.session import ship

DEPTH = 5
BITS = 6
SYMBOLS = 1 << BITS
ESCAPES = 4  # each with SYMBOLS bytes
RARE = SYMBOLS - ESCAPES  # the first escape
DIRECT = 4  # contexts of so many symbols are looked up in one table
MIN_COUNT = 2
HEAD_SHARE = 2e-7
WORD_SHARE = 4e-6
CHUNK = 1_000_000  # symbols worked on at once


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, which is what bytes.split() splits at."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n) summed within the task, and (null, number of texts)."""
    seen: Counter[bytes] = Counter()
    texts = 0
    out = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
    for b in slices(batches):
        for t in b.column("_text").to_pylist():
            seen.update(words_of(t))
            texts += 1
        if len(seen) > 500_000:
            yield out(seen)
            seen = Counter()
    yield out(seen)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([texts], pa.int64())], names=["word", "n"])


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256)
    for b in batches:
        words = b.column("word").to_pylist()
        n = np.array(b.column("n").to_pylist(), dtype=np.float64)
        total += np.bincount(np.frombuffer(b"".join(words), dtype=np.uint8), np.repeat(n, [len(w) for w in words]), 256)
        total[32] += n.sum()
    yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total.astype(np.int64))], names=["byte", "n"])


def byte_classes(counts: np.ndarray) -> np.ndarray:
    """Symbol of each byte: 0 is the end of a text (newline never stands in a word); SYMBOLS and its rank for a byte that
    is written as an escape and a second symbol."""
    classes = np.zeros(256, dtype=np.int64)
    order = [b for b in np.argsort(-counts, kind="stable") if b != 10]
    classes[order[: RARE - 1]] = np.arange(1, RARE)
    classes[order[RARE - 1 :]] = SYMBOLS + np.arange(len(order) - RARE + 1)
    return classes


def _chunks(texts: Iterable[list[bytes]]) -> Iterator[list[list[bytes]]]:
    """Texts (as words) in runs of about CHUNK symbols."""
    part, size = [], 0
    for words in texts:
        part.append(words)
        size += sum(map(len, words)) + len(words) + DEPTH + 1
        if size > CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def symbol_keys(lines: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (symbol in the low bits, nearest context symbol next) and where each text starts."""
    s = classes[np.frombuffer(b"".join(b"\n" * DEPTH + x + b"\n" for x in lines), dtype=np.uint8)]
    sizes = np.array([len(x) + DEPTH + 1 for x in lines])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    odd = np.flatnonzero(s >= SYMBOLS)
    if len(odd):
        rank = s[odd] - SYMBOLS
        s = np.repeat(s, 1 + (s >= SYMBOLS))
        at = odd + np.arange(len(odd))
        s[at] = RARE + rank // SYMBOLS
        s[at + 1] = rank % SYMBOLS
        begin += np.searchsorted(odd, begin)
    key = s.copy()
    for d in range(1, DEPTH + 1):
        key[d:] |= s[:-d] << (BITS * d)
    keep = np.ones(len(s), dtype=bool)
    keep[(begin[:, None] + np.arange(DEPTH)).ravel()] = False
    return key[keep], begin - DEPTH * np.arange(len(lines))


def _count_grams(classes: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []  # with a low bit for held-out texts
        counts: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, at = np.unique(np.concatenate(keys), return_inverse=True)
            return u, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        rows = lambda u, n: pa.RecordBatch.from_arrays([pa.array(u >> 1, pa.int64()), pa.array(np.where(u & 1, 0, n), pa.int64()), pa.array(n, pa.int64())], names=["key", "n", "m"])
        for b in slices(batches, 1_024):
            for held in (0, 1):
                texts = b.column("_text").filter(pc.equal(b.column("_held"), bool(held))).to_pylist()
                for part in _chunks(words_of(t) for t in texts):
                    u, n = np.unique(symbol_keys([b" ".join(w) for w in part], classes)[0], return_counts=True)
                    keys.append(u << 1 | held)
                    counts.append(n)
                    if sum(map(len, keys)) > 3_000_000:
                        u, n = merged()
                        if len(u) > 1_500_000:
                            yield rows(u, n)
                            keys, counts = [], []
                        else:
                            keys, counts = [u], [n]
        if keys:
            yield rows(*merged())

    return work


def gram_levels(grams: DataFrame) -> list[DataFrame]:
    """For each depth rows (key, n, m, t, k): how often the training and all texts have the pair of context and symbol, and
    how often and with how many symbols the training texts have the context."""
    pairs = materialize(grams.groupBy("key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "pst-grams")
    levels = []
    for d in range(DEPTH, -1, -1):
        if d < DEPTH:
            pairs = levels[-1].groupBy((F.col("key") % (SYMBOLS ** (d + 1))).alias("key")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        w = Window.partitionBy(F.expr(f"key div {SYMBOLS}"))  # at most SYMBOLS rows a context
        levels.append(materialize(pairs.select("key", "n", "m", F.sum("n").over(w).alias("t"), F.sum(F.expr("int(n > 0)")).over(w).alias("k")), f"pst-{d}"))
    return levels[::-1]


def kept_contexts(levels: list[DataFrame], min_count: int = MIN_COUNT) -> list[DataFrame]:
    """For each depth from 1 the contexts (ctx) that pass the count and divergence tests, with the suffixes of deeper ones."""
    kept: list[DataFrame] = []
    for d in range(DEPTH, 0, -1):
        up = levels[d - 1].select(F.col("key").alias("up"), F.col("n").alias("pn"), F.col("t").alias("pt"))
        own = levels[d].where((F.col("n") > 0) & (F.col("t") >= min_count)).withColumn("up", F.col("key") % SYMBOLS**d).join(up, "up")
        own = own.groupBy(F.expr(f"key div {SYMBOLS}").alias("ctx"), "k").agg(F.sum(F.expr("n * ln((n / t) / (pn / pt))")).alias("g"))
        own = own.where(F.col("g") > F.col("k")).select("ctx")
        if kept:
            own = own.unionByName(kept[-1].select((F.col("ctx") % SYMBOLS**d).alias("ctx"))).distinct()
        kept.append(materialize(own, f"pst-kept-{d}"))
    return kept[::-1]


def gram_scores(levels: list[DataFrame], kept: list[DataFrame]) -> DataFrame:
    """key, m and lp (log10 probability by the longest state) of each pair of DEPTH symbols and a next one in any text."""
    smooth = lambda parent: F.expr(f"(n + (k + 1) * {parent}) / (t + k + 1)")
    scored = levels[0].select("key", "m", smooth(f"{1 / SYMBOLS!r}D").alias("p"))
    for d in range(1, DEPTH + 1):
        up = scored.select(F.col("key").alias("up"), F.col("p").alias("pp"))
        states = kept[d - 1].select("ctx", F.lit(True).alias("state"))
        level = levels[d].withColumn("up", F.col("key") % SYMBOLS**d).join(up, "up").withColumn("ctx", F.expr(f"key div {SYMBOLS}")).join(states, "ctx", "left")
        scored = materialize(level.select("key", "m", F.when(F.col("state"), smooth("pp")).otherwise(F.col("pp")).alias("p")), f"pst-p-{d}")
    return scored.select("key", "m", F.log10("p").alias("lp"))


class SuffixTree:
    """The same model in memory, from arrays of (depth, ctx, sym, n) of its states: what the tables are tested against."""

    def __init__(self, depth: np.ndarray, ctx: np.ndarray, sym: np.ndarray, n: np.ndarray):
        self.index: list[dict[int, int]] = []
        rows: list[np.ndarray] = []
        for d in range(DEPTH + 1):
            m = depth == d
            u, at = np.unique(ctx[m].astype(np.int64), return_inverse=True)
            if d == 0 and not len(u):
                u, at = np.array([0]), np.array([], dtype=np.int64)
            counts = np.zeros((len(u), SYMBOLS), dtype=np.float32)
            np.add.at(counts, (at, sym[m]), n[m])
            if d == 0:
                parents = np.full((len(u), SYMBOLS), 1 / SYMBOLS, dtype=np.float32)
            else:
                up = self.index[d - 1]
                parents = rows[d - 1][np.array([up[int(c) % SYMBOLS ** (d - 1)] for c in u], dtype=np.int64)]
            k = ((counts > 0).sum(1, keepdims=True) + 1).astype(np.float32)
            total = counts.sum(1, keepdims=True, dtype=np.float64).astype(np.float32) + k
            parents *= k
            counts += parents
            counts /= total
            rows.append(counts)
            self.index.append({int(c): i for i, c in enumerate(u)})
        self.first = np.cumsum([0, *[len(r) for r in rows]])
        self.logp = np.concatenate(rows)
        np.log10(self.logp, out=self.logp)

    def prepare(self) -> None:
        """The direct table of the longest kept suffix of up to DIRECT symbols."""
        self.table = np.zeros(SYMBOLS**DIRECT, dtype=np.int32)
        for d in range(1, DIRECT + 1):
            view = self.table.reshape(-1, SYMBOLS**d)
            for c, i in self.index[d].items():
                view[:, c] = self.first[d] + i
        self.deep = np.array(sorted(self.index[DEPTH]), dtype=np.int64)
        self.parent = np.zeros(SYMBOLS**DIRECT, dtype=bool)
        self.parent[self.deep % SYMBOLS**DIRECT] = True

    def states(self, ctx: np.ndarray) -> np.ndarray:
        near = ctx & (SYMBOLS**DIRECT - 1)
        state = self.table[near]
        if len(self.deep):
            more = np.flatnonzero(self.parent[near])
            at = np.searchsorted(self.deep, ctx[more])
            at[at == len(self.deep)] = 0
            hit = self.deep[at] == ctx[more]
            state[more[hit]] = self.first[DEPTH] + at[hit]
        return state

    def score(self, lines: list[bytes], classes: np.ndarray) -> np.ndarray:
        """log10 probability of each text (its words joined by a space, then the end)."""
        key, begin = symbol_keys(lines, classes)
        return np.add.reduceat(self.logp[self.states(key >> BITS), key & (SYMBOLS - 1)].astype(np.float64), begin)


def _head_scores(lines: list[bytes], m: dict) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Score of each text's frequent pairs, and its other pairs with their counts."""
    key, begin = symbol_keys(lines, m["classes"])
    u, at = np.unique(key, return_inverse=True)
    near = np.minimum(np.searchsorted(m["keys"], u), max(len(m["keys"]) - 1, 0))
    hit = m["keys"][near] == u if len(m["keys"]) else np.zeros(len(u), dtype=bool)
    lp = np.zeros(len(u))
    lp[hit] = m["lp"][near[hit]]
    miss = np.flatnonzero(~hit[at])
    line = np.searchsorted(begin, miss, "right") - 1
    pair, n = np.unique(line * len(u) + at[miss], return_counts=True)
    cut = np.searchsorted(pair, np.arange(1, len(lines)) * len(u))
    return np.add.reduceat(lp[at], begin), np.split(u[pair % len(u)], cut), np.split(n, cut)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int64()))


def _score(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        top = dict(zip(m["words"].column("word").to_pylist(), m["words"].column("p").to_pylist(), strict=True))
        for b in slices(batches):
            scores, grams, gram_counts, tokens, base, known, rare_words, rare_counts = [], [], [], [], [], [], [], []
            for part in _chunks(words_of(t) for t in b.column("_text").to_pylist()):
                score, other, n_other = _head_scores([b" ".join(w) for w in part], m)
                scores.append(score)
                grams += other
                gram_counts += n_other
                for words in part:
                    s, k, rw, rn = m["end"], m["end_known"], [], []
                    for w, n in Counter(words).items():
                        if (p := top.get(w)) is not None:
                            s += n * p
                            k += n
                        else:
                            rw.append(w)
                            rn.append(n)
                    tokens.append(len(words) + 1)
                    base.append(s)
                    known.append(k)
                    rare_words.append(rw)
                    rare_counts.append(rn)
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(rare_words, pa.list_(pa.binary())), pa.array(rare_counts, pa.list_(pa.int64())), _lists(grams), _lists(gram_counts)],
                names=["_id", "n_tokens", "known", "base", "score", "words", "counts", "grams", "gram_counts"],
            )

    return work


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """Train on the other folds, score every text: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    held: Column = bucket_of(F.col("_id"), folds) == held_fold
    train = src.where(~held).select("_text")
    counted = materialize(train.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "pst-words")
    vocab = counted.where(F.col("word").isNotNull())
    sizes = counted.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("word").isNotNull(), 1).otherwise(0)).alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("texts")).first()
    texts = sizes["texts"] or 0
    total, distinct = sizes["n"] or 0, (sizes["v"] or 0) + (texts > 0)
    log_p = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    by_byte = np.zeros(256)
    for r in vocab.mapInArrow(_count_bytes, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        by_byte[r["byte"]] = r["n"]
    classes = byte_classes(by_byte)
    grams = src.select("_text", held.alias("_held")).mapInArrow(_count_grams(classes), "key long, n long, m long")
    levels = gram_levels(grams)
    scores = materialize(gram_scores(levels, kept_contexts(levels)), "pst-scores")
    symbols = levels[0].agg(F.sum("m")).first()[0] or 0
    head = scores.where(F.col("m") >= max(2.0, HEAD_SHARE * symbols)).select("key", "lp").toArrow().sort_by("key")  # at most 1 / HEAD_SHARE pairs
    frequent = vocab.where(F.col("n") >= max(2.0, WORD_SHARE * total))  # at most 1 / WORD_SHARE words
    top = frequent.select("word", F.log10((F.col("n") + 0.5) / F.lit(total + 0.5 * (distinct + 1))).alias("p")).toArrow()
    model = spark.sparkContext.broadcast({"keys": head.column("key").to_numpy(), "lp": head.column("lp").to_numpy(), "classes": classes, "words": top, "end": log_p(texts), "end_known": int(texts > 0)})
    kind = dict(src.dtypes)["_id"]
    scored = src.mapInArrow(_score(model), f"_id {kind}, n_tokens long, known long, base double, score double, words array<binary>, counts array<long>, grams array<long>, gram_counts array<long>")
    rows = materialize(scored.withColumn("_r", F.monotonically_increasing_id()), "pst-scored")
    odd = rows.select("_r", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("_r", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    odd = odd.join(vocab, "word", "left")
    logs = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    odd = odd.groupBy("_r").agg(F.sum(F.col("c") * logs).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("c")).otherwise(0)).alias("more_known"))
    deep = rows.select("_r", F.explode(F.arrays_zip("grams", "gram_counts")).alias("g")).select("_r", F.col("g.grams").alias("key"), F.col("g.gram_counts").alias("c"))
    deep = deep.join(scores, "key").groupBy("_r").agg(F.sum(F.col("c") * F.col("lp")).alias("more_score"))
    out = rows.drop("words", "counts", "grams", "gram_counts").join(odd, "_r", "left").join(deep, "_r", "left")
    return out.select(
        F.col("_id").alias(id_col),
        held.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
