"""Benchmark decontamination with a distributed positional inverted index of the training texts.

Query windows are the runs of n consecutive words of each benchmark item. Terms are counted over all texts, and the
window's rarest term is where its search starts. The index stores the postings of these terms: (term, text, position,
near), where near holds the terms of the SLOP words on both sides, so that the posting lists of the window's further
terms can be intersected at their offsets without fetching them, from the rarest term on: most postings fall out at the
second term. Terms that all stand at their own offsets are an exact match; terms that all stand in near, in any order, are
a proximity match.

The text's row is searched for wanted terms by a bit table of their hashes before anything is exploded, so that only
postings of rare terms are written. Texts are known by their digest, so copies share one result, and no text is
shuffled unless more than RESULTS texts have a match. Terms are compared by 64-bit hash. Sides are broadcast behind a
check of their number of rows; beyond it they meet in a sort-merge join.

Defined cases: a null text has no words; items without words match nothing; an item shorter than n is one window; a
null item_id counts as the empty text; an empty table on either side gives texts without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import alnum_split, ascii_lower, materialize

N = 10
SLOP = 20
TERMS = 1_000_000  # distinct benchmark terms (16 bytes each) to broadcast
WINDOWS = 50_000  # windows (about 250 bytes each) to broadcast
RESULTS = 200_000  # texts with a match (about 100 bytes each) to broadcast


def _words(text: Column) -> Column:
    return alnum_split(ascii_lower(F.coalesce(text, F.lit(""))))


def _terms(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, a written table, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def item_windows(items: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of all items: item_id (string), terms (hashes), len."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), _terms(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - n + 1, F.lit(1)))
    w = w.select("item_id", "_w", F.explode(starts).alias("_s")).select("item_id", F.slice("_w", F.col("_s"), F.lit(n)).alias("terms"))
    return w.select("item_id", "terms", F.size("terms").alias("len")).distinct()


def term_counts(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """term, c: occurrences in the texts of each term of the windows that any text has."""
    vocab = materialize(windows.select(F.explode("terms").alias("term")).distinct(), "decontam-terms")
    toks = docs.select(F.explode(_terms(F.col(text_col))).alias("term"))
    if vocab.count() > TERMS:  # each task's counts first, so that no frequent term is shuffled
        return materialize(toks.groupBy("term").agg(F.count("*").alias("c")).join(vocab, "term", "left_semi"), "decontam-counts")
    return materialize(toks.join(F.broadcast(vocab), "term").groupBy("term").agg(F.count("*").alias("c")), "decontam-counts")


def anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows by their rarest term (of equal ones the first): term, off, len, item_id, terms, order (the offsets from the
    rarest term on). Windows with a term that no text has are dropped."""
    each = windows.select("item_id", "terms", "len", F.posexplode("terms").alias("off", "term")).join(counts, "term", "left")
    ranked = each.groupBy("item_id", "terms", "len").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "off"))).alias("r"))  # n at most
    ranked = ranked.where(F.col("r")[0]["c"] > 0).withColumn("order", F.transform("r", lambda x: x["off"]))
    return ranked.select(F.expr("terms[order[0]]").alias("term"), F.col("order")[0].alias("off"), "len", "item_id", "terms", "order")


def _bit_table(terms: DataFrame) -> tuple[str, int]:
    """A comma-separated table of 64-bit words in which a term's bit is set, and its number of bits."""
    bits = min(max(1 << 13, 1 << (16 * terms.count()).bit_length()), 1 << 20)
    words = terms.select(F.expr(f"term & {bits - 1}L").alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(b % 64)))").alias("v"))
    table = [0] * (bits // 64)
    for r in words.collect():  # at most 16,384 words
        table[r["w"]] = r["v"]
    return ",".join(map(str, table)), bits


def positional_index(docs: DataFrame, terms: DataFrame, text_col: str = "text", slop: int = SLOP) -> DataFrame:
    """Postings (term, _k, pos, near, left) of the given distinct terms in all texts; near has the terms from left words
    before pos to slop words after it."""
    table, bits = _bit_table(terms)
    h = docs.select(_digest(F.col(text_col)).alias("_k"), _terms(F.col(text_col)).alias("_h"))
    b = f"(get(_h, i) & {bits - 1}L)"
    set_bit = f"shiftright(get(_bits, int({b} div 64)), int({b} % 64)) & 1L = 1L"
    h = h.withColumn("_bits", F.split(F.lit(table), ",").cast("array<bigint>"))
    h = h.selectExpr("_k", "_h", f"CASE WHEN size(_h) > 0 THEN filter(sequence(0, size(_h) - 1), i -> {set_bit}) END AS _p")
    posting = f"transform(_p, p -> named_struct('term', get(_h, p), 'pos', p, 'near', slice(_h, greatest(p - {slop}, 0) + 1, least(p, {slop}) + 1 + {slop}), 'left', least(p, {slop})))"
    # outer, as the planner would move the test for empty arrays below _h and make that again for each word
    found = h.selectExpr("_k", f"{posting} AS _c").select("_k", F.explode_outer("_c").alias("c")).select("_k", "c.*")
    return found.join(_bounded(terms, TERMS), "term", "left_semi")


def matches(docs: DataFrame, items: DataFrame, n: int = N, slop: int = SLOP, item_id: str = "item_id", item_text: str = "text", text_col: str = "text") -> DataFrame:
    """Postings of a window's rarest term with a match: _k, pos, near (array of windows whose terms all stand within slop
    words) and exact (those of them at the windows' own offsets)."""
    if slop < n - 1:
        raise ValueError("a window must lie within slop words of each of its terms")
    windows = materialize(item_windows(items, n, item_id, item_text), "decontam-windows")
    found = materialize(anchors(windows, term_counts(docs, windows, text_col)), "decontam-anchors")
    index = materialize(positional_index(docs, materialize(found.select("term").distinct(), "decontam-rarest"), text_col, slop), "decontam-index")
    few = found.count() <= WINDOWS
    by_term = found.groupBy("term").agg(F.collect_list(F.struct("off", "len", "item_id", "terms", "order")).alias("wins"))
    # the windows of one term are in one row only while all windows are few; else each is a row of its own
    at = index.join(F.broadcast(by_term), "term") if few else index.join(found, "term").withColumn("wins", F.array(F.struct("off", "len", "item_id", "terms", "order")))
    near = "filter(wins, w -> forall(w.order, o -> array_contains(near, get(w.terms, o))))"
    at = at.selectExpr("_k", "pos", "left", "near AS _near", f"{near} AS near").where(F.size("near") > 0)
    exact = "filter(near, w -> left >= w.off AND forall(w.order, o -> get(_near, left - w.off + o) <=> get(w.terms, o)))"
    return at.selectExpr("_k", "pos", f"transform({exact}, w -> named_struct('s', pos - w.off, 'e', pos - w.off + w.len, 'item_id', w.item_id)) AS exact", "transform(near, w -> w.item_id) AS near")


def contamination(docs: DataFrame, items: DataFrame, n: int = N, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each text: keep columns (default the id), n_words, n_hit (words inside an occurring window), n_items, items
    (their ids as sorted strings), n_near (items with a proximity match) and contaminated."""
    keep = [id_col] if keep is None else keep
    found = matches(docs, items, n, text_col=text_col)
    # one text's distinct matches in a row, put together in each task first
    one = found.select("_k", F.explode_outer("exact").alias("x"), "near").groupBy("_k").agg(F.collect_set("x").alias("_m"), F.array_distinct(F.flatten(F.collect_set("near"))).alias("_near"))
    spans = "array_sort(array_distinct(transform(_m, x -> named_struct('s', x.s, 'e', x.e))))"
    n_hit = f"aggregate({spans}, named_struct('e', 0, 't', 0), (a, x) -> named_struct('e', greatest(a.e, x.e), 't', a.t + greatest(0, x.e - greatest(a.e, x.s))), a -> a.t)"
    one = materialize(one.select("_k", F.expr(f"bigint({n_hit})").alias("n_hit"), F.expr("array_sort(array_distinct(transform(_m, x -> x.item_id)))").alias("items"), F.size("_near").cast("long").alias("n_near")), "decontam-results")
    rows = docs.select(*[F.col(c).alias(f"_o_{c}") for c in keep], _digest(F.col(text_col)).alias("_k"), F.size(_words(F.col(text_col))).cast("long").alias("_n"))
    both = rows.join(_bounded(one, RESULTS), "_k", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.select(
        *[F.col(f"_o_{c}").alias(c) for c in keep],
        F.col("_n").alias("n_words"),
        zero("n_hit").alias("n_hit"),
        zero(F.when(F.col("items").isNotNull(), F.size("items"))).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        zero("n_near").alias("n_near"),
        (zero("n_hit") > 0).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places where all terms of a window stand, in any order, within slop words of its rarest term: id, item_id, pos (of
    the rarest term)."""
    found = matches(docs, items, n, slop, text_col=text_col).select("_k", "pos", F.explode(F.array_distinct("near")).alias("item_id")).distinct()
    rows = docs.select(F.col(id_col), _digest(F.col(text_col)).alias("_k"))
    return rows.join(materialize(found, "decontam-near"), "_k").select(id_col, "item_id", F.col("pos").cast("long").alias("pos"))
