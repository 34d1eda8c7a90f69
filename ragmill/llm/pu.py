"""Positive-unlabelled quality classifier: non-negative unbiased risk (nnPU) over text statistics.

Trusted positives are labelled 1 in the training folds; the unlabelled rows are training-fold texts whatever their
label, and no label of 0 is read. The class prior is estimated from these two samples: a first classifier of positives
against unlabelled texts orders both, and the prior is the least ratio of the unlabelled to the positive share above a
cut, over all cuts, with a confidence margin for small shares (a cut above which all is positive gives the prior itself;
any other gives more). Then the risk
    prior * E_pos[loss(g, +1)] + max(0, E_unl[loss(g, -1)] - prior * E_pos[loss(g, -1)])
with logistic loss is minimised over a linear function of clipped, piecewise-linear statistics, so that the sigmoid of
it is the probability of label 1. Training takes about `max_rows` positives and as many unlabelled rows at most (all, or
the share max_rows / n by a hash of id and statistics, a hash's repeats counting once), a documented bound that keeps
what reaches the driver near 2 * max_rows * 8 numbers; every row is scored, in built-in functions.

Defined cases: null and empty texts are scored like any other (all statistics 0); an id with several labels is positive
if one of them is 1; with no positive or no text in the training folds every score is 0.5.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import bucket_of, materialize
from ragmill.llm.text_stats import STATS, text_stats

MAX_ROWS = 20_000
THRESHOLD = 0.3
NAMES = ("symbols", "marks", "repeats", "distinct", "word_length", "dup_lines", "size")
CLIP = (-4.0, 8.0)
KNEE = 2.0


def features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_marks") / n),
        F.col("n_repeat_words") / n,
        F.col("n_distinct") / F.pow(n.cast("double"), F.lit(0.9)),
        F.log1p(F.col("word_chars") / n),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.log1p(F.col("n_words")),
    ]


def _expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / scale, *CLIP)
    return np.hstack([z, np.maximum(z - KNEE, 0), np.maximum(-z - KNEE, 0), np.ones((len(x), 1))])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def _scaling(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spread = np.subtract(*np.percentile(pos, [90, 10], axis=0)) / 2.56
    return np.median(pos, axis=0), np.maximum(spread, [0.1, 0.08, 0.1, 0.1, 0.08, 0.1, 0.5])


def _adam(gradient, size: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        grad = gradient(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _shrink(w: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    return l2 * np.append(w[:-1], 0)


def estimate_prior(pos: np.ndarray, unl: np.ndarray, sure: float = 0.05) -> float:
    """Share of positives in unl. Even rows fit the ordering, odd rows are counted."""
    if len(pos) < 4 or len(unl) < 4:
        return 0.5
    centre, scale = _scaling(pos)
    p, u = _expand(pos, centre, scale), _expand(unl, centre, scale)
    fit = lambda w: ((u[::2] * _sigmoid(u[::2] @ w)[:, None]).mean(0) - (p[::2] * _sigmoid(-(p[::2] @ w))[:, None]).mean(0)) / 2 + _shrink(w)
    w = _adam(fit, p.shape[1], steps=300)
    gp, gu = np.sort(p[1::2] @ w), np.sort(u[1::2] @ w)
    share_p = 1 - np.arange(len(gp)) / len(gp)  # of positives at or above each positive's score
    share_u = 1 - np.searchsorted(gu, gp, "left") / len(gu)
    margin = math.sqrt(math.log(4 / sure) / 2 / len(gu)) + math.sqrt(math.log(4 / sure) / 2 / len(gp))
    best = int(np.argmin((share_u + margin) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float) -> dict:
    """Full-batch Adam on the non-negative risk; when the corrected negative part falls below 0 its gradient is reversed."""
    centre, scale = _scaling(pos)
    p, u = _expand(pos, centre, scale), _expand(unl, centre, scale)

    def gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_pos = -prior * (p * _sigmoid(-gp)[:, None]).mean(0)
        d_neg = (u * _sigmoid(gu)[:, None]).mean(0) - prior * (p * _sigmoid(gp)[:, None]).mean(0)
        return (d_pos + d_neg if negative >= 0 else -d_neg) + _shrink(w)

    return {"centre": centre.tolist(), "scale": scale.tolist(), "weights": _adam(gradient, p.shape[1]).tolist()}


def score_column(model: dict | None) -> Column:
    if model is None:
        return F.lit(0.5)
    k, g = len(NAMES), F.lit(model["weights"][-1])
    for i, f in enumerate(features()):
        z = F.greatest(F.lit(CLIP[0]), F.least(F.lit(CLIP[1]), (f - F.lit(model["centre"][i])) / F.lit(model["scale"][i])))
        w = model["weights"]
        g = g + z * F.lit(w[i]) + F.greatest(z - KNEE, F.lit(0.0)) * F.lit(w[k + i]) + F.greatest(-z - KNEE, F.lit(0.0)) * F.lit(w[2 * k + i])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), g))))


def _sample(rows: DataFrame, max_rows: int) -> np.ndarray:
    """Feature vectors of all rows, or of the share max_rows / n of them by a hash, in the order of the hash. Rows of one
    id and statistics share a hash and then count once, so a hot id brings no more than its different texts' share."""
    n = rows.count()
    part = rows.withColumn("_o", F.xxhash64("_id", *NAMES, F.lit("sample")))
    if n > max_rows:
        part = part.where(F.pmod(F.col("_o"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n)).dropDuplicates(["_o"])
    got = sorted(tuple(r) for r in part.select("_o", *NAMES).collect())
    return np.array([r[1:] for r in got], dtype=float)


def pu_scores(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, max_rows: int = MAX_ROWS) -> DataFrame:
    """Score each text: keep columns (default the id; they may have the text itself), held_out, score, predicted (score >=
    0.3). A row per input row; what is kept is written once with the statistics, and no text is shuffled."""
    keep = [id_col] if keep is None else keep
    src = docs.select(*[F.col(c).alias(f"_k_{c}") for c in keep], F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    cols = [c for c in src.columns if c != "_text"]
    stats = materialize(text_stats(src, cols, "_text"), "pu-stats")
    train = stats.where(bucket_of(F.col("_id"), folds) != held_fold).select("_id", *[f.alias(n) for f, n in zip(features(), NAMES, strict=True)])
    positive = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull() & (bucket_of(F.col(id_col), folds) != held_fold)).select(F.col(id_col).alias("_id"))
    pos = _sample(train.join(positive, "_id", "left_semi"), max_rows)
    unl = _sample(train, max_rows)
    model = fit_nnpu(pos, unl, estimate_prior(pos, unl)) if len(pos) and len(unl) else None
    out = stats.select(*[F.col(f"_k_{c}").alias(c) for c in keep], (bucket_of(F.col("_id"), folds) == held_fold).alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
