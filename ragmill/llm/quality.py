"""Robust quality rules: minimum-covariance-determinant (MCD) estimates per language and source.

Each text's statistics become a vector of integers (square roots and logarithms of rates, in thousandths). For each
group three deterministic starts (all rows; medians and quartile widths; the rows near the medians in every statistic)
are refined by concentration steps: distances under the present estimate, the threshold that holds the nearest share of
rows (from an exact histogram of distances, so no group is sorted in one task), then mean and covariance of those rows
from integer sums, which do not depend on the order of rows. Steps end when no determinant falls any more (MAX_STEPS at
most). The start with the least determinant gives the estimate; texts beyond the chi-square cutoff go. Estimates are a
few rows a group and come to the rows by broadcast, or by salted keys if there are very many groups.

A short text's rates vary more, so a text is judged under the group's covariance plus the sampling variance of its own
rates (NOISE): counts are Poisson, so that their square roots have 1 / (4 n); repeats come as two copies of a line; the
mean word length has the words' spread over n. FLOOR is only what rounding to thousandths needs.

Groups of fewer than MIN_GROUP rows are pooled by language, then with all other such rows; a pool with fewer than
2 * (dimension + 1) rows rejects nothing.

Defined cases: null or empty text has no words and fails the base rule; null languages and sources are groups of their
own; copies each count; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.llm.common import join_groups, materialize
from ragmill.llm.text_stats import WINDOW, text_stats

UNIT = 1_000
FLOOR = (0.003, 0.003, 0.003, 0.003)  # of symbols, marks, repeats, log word length
SPREAD = 0.3  # squared coefficient of variation of word lengths
#: variance of the own rates of a text of _nw words, where a repeat has _unit words; m2 is the group's repeats in thousandths
NOISE = ("0.25D / _nw", "0.25D / _nw", f"pow(_unit / _nw, 2) + _unit * greatest(m2, 0D) / {UNIT} / _nw", f"{SPREAD}D / _nw")
MIN_GROUP = 200
KEEP_SHARE = 0.75
MAX_STEPS = 12
CENTRAL = 1.5  # robust standard deviations from the median, in every statistic
BINS = 64  # of the distance histogram, for each factor of e
TAIL = 1e-3
DIM = len(FLOOR)
SETTLED = DIM / 2 / BINS  # of half the log determinant: what one bin is worth
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def chi2_tail(x: float, p: int) -> float:
    """P(chi-square of an even number p of degrees of freedom > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(tail: float, p: int) -> float:
    lo, hi = 0.0, 1_000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, p) > tail else (lo, mid)
    return hi


CUTOFF = chi2_quantile(TAIL, DIM)
#: makes the covariance of the nearest KEEP_SHARE of Gaussian rows that of all
CONSISTENCY = KEEP_SHARE / (1 - chi2_tail(chi2_quantile(1 - KEEP_SHARE, DIM), DIM + 2))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = [F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_marks") / n), F.col("n_repeat_words") / n, F.log1p(F.col("word_chars") / n)]
    return [F.round(r * UNIT).cast("long") for r in raw]


def _with_distance(rows: DataFrame, keep: list[str], name: str, wrap: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution with the group's Cholesky factor (later columns use the
    aliases of earlier ones)."""
    z = [f"({' - '.join([f'x{i}', f'm{i}', *[f'l{i}{k} * z{k}' for k in range(i)]])}) / l{i}{i} AS z{i}" for i in range(DIM)]
    total = " + ".join(f"z{i} * z{i}" for i in range(DIM))
    return rows.selectExpr(*keep, *z, f"{wrap.format(f'({total})')} AS {name}").drop(*[f"z{i}" for i in range(DIM)])


def _factor() -> list[str]:
    """The Cholesky factor l{i}{j} of c{i}{j} (later columns use the aliases of earlier ones)."""
    steps = []
    for i, j in PAIRS:
        s = " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])
        steps.append(f"sqrt(greatest({s}, 1e-9D)) AS l{i}{j}" if i == j else f"({s}) / l{j}{j} AS l{i}{j}")
    return steps


def _own_distance() -> Column:
    """Squared Mahalanobis distance under each text's own covariance: the group's (from its factor) and NOISE. One
    dimension is eliminated at a time; each step's values are bound once, as the element of an array, so a filter on the
    verdict that Catalyst moves below the projection stays as small as it is."""
    unit = f"greatest({WINDOW}, 2 * greatest(n_words, 1) / greatest(n_lines, 1))"
    own = [n.replace("_nw", "greatest(n_words, 1)").replace("_unit", unit) for n in NOISE]
    cov = [F.expr(" + ".join([f"l{i}{k} * l{j}{k}" for k in range(j + 1)] + ([f"{UNIT**2}D * ({own[i]})"] if i == j else []))).alias(f"c{i}{j}") for i, j in PAIRS]
    state = F.struct(F.lit(0.0).alias("total"), *[F.expr(f"double(x{i} - m{i})").alias(f"d{i}") for i in range(DIM)], *cov)

    def eliminate(s: Column, k: int) -> Column:
        """The state without dimension k."""
        pivot = F.greatest(s[f"c{k}{k}"], F.lit(1e-9))
        rest = range(k + 1, DIM)
        left = [(s[f"d{i}"] - s[f"c{i}{k}"] * s[f"d{k}"] / pivot).alias(f"d{i}") for i in rest]
        square = [(s[f"c{i}{j}"] - s[f"c{i}{k}"] * s[f"c{j}{k}"] / pivot).alias(f"c{i}{j}") for i in rest for j in rest if j <= i]
        return F.struct((s["total"] + s[f"d{k}"] * s[f"d{k}"] / pivot).alias("total"), *left, *square)

    steps = F.array(state)
    for k in range(DIM):
        steps = F.transform(steps, lambda s: eliminate(s, k))  # noqa: B023 - called at once
    return steps[0]["total"]


def _cholesky(est: DataFrame) -> DataFrame:
    """Rows with n, m{i}, the factor l{i}{j} and the log determinant, from rows with m{i} and c{i}{j}."""
    det = " + ".join(f"ln(l{i}{i})" for i in range(DIM))
    return est.selectExpr("_g", "start", *(["was"] if "was" in est.columns else []), "n", *[f"m{i}" for i in range(DIM)], *_factor(), f"{det} AS logdet")


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """Estimates from integer sums over rows with _g, start, x{i}."""
    sums = [F.expr("count(*) AS n"), *[F.expr(f"sum(x{i}) AS s{i}") for i in range(DIM)], *[F.expr(f"sum(x{i} * x{j}) AS q{i}{j}") for i, j in PAIRS]]
    by = ["_g", "start", *(["was"] if "was" in rows.columns else [])]
    t = rows.groupBy(*by).agg(*sums)
    cov = [f"(q{i}{j} - double(s{i}) * s{j} / n) / n * {factor!r}D" + (f" + {(FLOOR[i] * UNIT) ** 2!r}D" if i == j else "") + f" AS c{i}{j}" for i, j in PAIRS]
    return _cholesky(t.selectExpr(*by, "n", *[f"s{i} / n AS m{i}" for i in range(DIM)], *cov))


def _median_start(rows: DataFrame) -> DataFrame:
    q = rows.groupBy("_g").agg(F.count("*").alias("n"), *[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1_000).alias(f"p{i}") for i in range(DIM)])
    # the quartiles of a Gaussian are 1.349 standard deviations apart
    cov = [(f"pow((p{i}[2] - p{i}[0]) / 1.349D, 2) + {(FLOOR[i] * UNIT) ** 2!r}D" if i == j else "0D") + f" AS c{i}{j}" for i, j in PAIRS]
    return _cholesky(q.selectExpr("_g", "1 AS start", "n", *[f"double(p{i}[1]) AS m{i}" for i in range(DIM)], *cov))


def _with_groups(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """_g: (language, source), or the pool of the small groups of a language, or of all."""
    ok = rows.where(~F.col("base_failed"))
    key = F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s")), {"ignoreNullFields": "false"})
    pool = F.to_json(F.struct(F.col(lang).alias("l")), {"ignoreNullFields": "false"})
    groups = ok.groupBy(key.alias("_key"), pool.alias("_pool")).agg(F.count("*").alias("k"))
    small = groups.where(F.col("k") < MIN_GROUP).groupBy("_pool").agg(F.sum("k").alias("k"))
    groups = groups.join(small.withColumnRenamed("k", "in_pool"), "_pool", "left")
    name = F.when(F.col("k") >= MIN_GROUP, F.col("_key")).when(F.col("in_pool") >= MIN_GROUP, F.col("_pool")).otherwise(F.lit("*"))
    named = materialize(groups.select("_key", name.alias("_g")), "quality-groups")
    return join_groups(rows.withColumn("_key", key), named, ["_key"]).drop("_key")


def _central(rows: DataFrame, medians: DataFrame, groups: int) -> DataFrame:
    """The moments of the rows near their group's medians (start 2)."""
    near = " AND ".join(f"abs(x{i} - m{i}) <= {CENTRAL} * l{i}{i}" for i in range(DIM))
    return _moments(join_groups(rows, medians, ["_g"], "inner", groups).where(near).withColumn("start", F.lit(2)), 1.0)


def mcd_estimates(rows: DataFrame) -> DataFrame:
    """MCD estimate of each group _g of integer vectors x0.. ; a row a group. rows must be a written table."""
    both = rows.select("_g", *[f"x{i}" for i in range(DIM)])
    medians = materialize(_median_start(both), "mcd-medians")
    groups = 3 * medians.count()
    starts = _moments(both.withColumn("start", F.lit(0)), 1.0).unionByName(medians).unionByName(_central(both, medians.drop("start", "n"), groups))
    est = materialize(starts, "mcd-start")
    for step in range(MAX_STEPS):
        far = _with_distance(join_groups(both, est, ["_g"], "inner", groups), ["_g", "start", *[f"x{i}" for i in range(DIM)]], "bin", f"floor(log1p({{}}) * {BINS})")
        bins = far.groupBy("_g", "start", "bin").agg(F.count("*").alias("k"))
        w = Window.partitionBy("_g", "start")  # a few hundred bins a group
        cum = bins.select("_g", "start", "bin", F.sum("k").over(w.orderBy("bin")).alias("c"), F.sum("k").over(w).alias("t"))
        cut = cum.where(F.col("c") >= F.col("t") * KEEP_SHARE).groupBy("_g", "start").agg(F.min("bin").alias("cut"))
        held = est.drop("was").withColumnRenamed("logdet", "was").join(cut, ["_g", "start"])  # a row a group and start
        near = _with_distance(join_groups(both, held, ["_g"], "inner", groups), ["_g", "start", "was", "cut", *[f"x{i}" for i in range(DIM)]], "bin", f"floor(log1p({{}}) * {BINS})")
        est = materialize(_moments(near.where(F.col("bin") <= F.col("cut")), CONSISTENCY), f"mcd-{step}")
        if step > 1 and est.where(F.col("logdet") < F.col("was") - SETTLED).isEmpty():
            break
    est = est.drop("was")
    best = est.groupBy("_g").agg(F.min_by(F.struct(*est.columns), F.struct("logdet", "start")).alias("e"))
    return materialize(best.select("e.*"), "mcd")


def quality_rules(docs: DataFrame, keep: list[str] | None = None, lang: str = "lang", source: str = "source", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of each text: keep columns (which may have the text itself), n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, distance (squared; null where the base rule failed) and kept. What is kept
    is written once with the statistics and judged in its own row; no text is shuffled."""
    keep = ["doc_id"] if keep is None else keep
    src = docs.select(*[F.col(c).alias(f"_k_{c}") for c in keep], F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text_col).alias("_text"))
    cols = [c for c in src.columns if c != "_text"]
    stats = text_stats(src, cols, "_text")
    stats = materialize(stats.select(*cols, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", base_failed().alias("base_failed"), *[v.alias(f"x{i}") for i, v in enumerate(vector())]), "quality-stats")
    rows = _with_groups(stats, "_lang", "_source")
    narrow = rows.where(~F.col("base_failed")).select("_g", *[f"x{i}" for i in range(DIM)])
    est = mcd_estimates(materialize(narrow, "quality-vectors"))
    judged = join_groups(rows, est.withColumnRenamed("n", "_n").drop("start", "logdet"), ["_g"])
    distance = F.when(~F.col("base_failed") & (F.col("_n") >= 2 * (DIM + 1)), _own_distance())
    judged = judged.withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return judged.select(*[F.col(f"_k_{c}").alias(c) for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
