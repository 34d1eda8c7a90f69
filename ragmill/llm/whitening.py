"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become integers, so counts, sums and deviations are exact. The fit list (each distinct vector once) is written
once; every step of the iteration is one pass over it in which each task multiplies its centred rows with the current
basis and returns a matrix of dimensions x directions, nothing larger. A polynomial recurrence over such passes damps
the spectrum below the basis' smallest Ritz value, then QR and Rayleigh-Ritz follow, until the residuals of the wanted
components and a probe outside their span certify them.

Rows whose vector is null, empty, or holds an entry that is null, not finite or of 2**46 or more in size are dropped, and
so are vectors of another length than the commonest (of equally common ones the longest). Components without variance
(fewer rows than dimensions, constant dimensions) are left out, so a table of one distinct vector gives no rows.
Repeated rows and ids are answered each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.llm.common import materialize
from ragmill.session import ship

#: Fixed values of the integer grid.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Directions kept besides the wanted ones, steps at most, residual to reach, least share of the trace, most the wanted spectrum may be spread by a filter.
GUARD, STEPS, RESIDUAL, NO_VARIANCE, SPREAD = 32, 200, 1e-13, 1e-12, 1e6
#: Bytes of partial sums that the driver adds up itself; more are added in tasks.
PARTIALS = 32 << 20


def grid_vector(embedding: Column) -> Column:
    """Integer vector of an embedding; null where a row is to be dropped."""
    scaled = lambda c: c.cast("double") * SCALE
    good = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(scaled(c)) & (F.abs(scaled(c)) < float(1 << 52)))
    return F.when(good & (F.size(embedding) > 0), F.transform(embedding, lambda c: F.floor(scaled(c)) + SHIFT))


@dataclass
class Centre:
    """Count and sums of the fit list; goes to the tasks."""

    n: int
    sums: list[int]
    #: whether n * x and its deviations stay below 2**62
    small: bool

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they fit, else Python's."""
        if self.small:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n


class FitList:
    """The written fit list with its count, sums and the passes over it."""

    def __init__(self, vectors: DataFrame, dims: int):
        self.rows, self.dims = materialize(vectors.select("x").distinct(), "whitening-fit"), dims
        ship(vectors.sparkSession)
        row = self.rows.withColumn("task", F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("top"), F.countDistinct("task").alias("tasks")).first()
        self.n, self.tasks = row["n"], row["tasks"]
        half = 1 << 20  # sums of upper and lower parts stay within 64 bits
        parts = self.total(lambda x: np.stack([(x // half).sum(0), (x % half).sum(0)]), 2, "long")
        centre = self.centre = Centre(self.n, [int(a) * half + int(b) for a, b in parts], self.n * row["top"] < 1 << 62)
        self.trace = float(self.total(lambda x: (centre.centred(x) ** 2).sum(0)[None], 1).sum()) / self.n

    def total(self, part: Callable[[np.ndarray], np.ndarray], width: int, kind: str = "double") -> np.ndarray:
        """Sum over all rows of what `part` makes of a matrix of some rows: (width, dims), returned as (dims, width)."""
        dims, size = self.dims, self.dims * width

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = None
            for x in matrices(batches, dims):
                more = part(x)
                got = more if got is None else got + more
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array([got.T.ravel().tolist()])], names=["v"])

        out = self.rows.select("x").mapInArrow(work, f"v array<{kind}>")
        if self.tasks * size * 8 <= PARTIALS:
            sums = np.sum([np.array(r["v"]) for r in out.collect()], axis=0)
        else:
            cells = out.select(F.posexplode("v").alias("cell", "value")).groupBy("cell").agg(F.sum("value").alias("value"))
            got = cells.toArrow()
            sums = np.zeros(size, np.int64 if kind == "long" else np.float64)
            sums[got["cell"].to_numpy()] = got["value"].to_numpy()
        return sums.reshape(dims, width)

    def times(self, q: np.ndarray) -> np.ndarray:
        """Covariance times q, without the covariance: the centred rows times q, then their transpose times that."""
        centre = self.centre

        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return (c.T @ (c @ q)).T

        return self.total(part, q.shape[1]) / self.n


def matrices(batches: Iterator[pa.RecordBatch], dims: int, column: str = "x") -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            yield b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def chebyshev(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, cut: float, degree: int) -> np.ndarray:
    """The polynomial of this degree that stays within 1 on [0, cut] and grows fastest above, applied to q; vq is times(q)."""
    before, now = q, 2 / cut * vq - q
    for _ in range(degree - 1):
        before, now = now, 2 * (2 / cut * times(now) - now) - before
    return now


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), their vectors in the span of q, and these times the covariance."""
    h = q.T @ vq
    values, z = np.linalg.eigh((h + h.T) / 2)
    z = z[:, ::-1]
    return values[::-1], q @ z, vq @ z


def filter_degree(top: float, wanted: float, cut: float) -> int:
    """Highest degree up to 12 for which the filter spreads the wanted spectrum by at most SPREAD."""
    grow = lambda e: np.arccosh(max(1.0, 2 * e / cut - 1))
    apart = grow(top) - grow(wanted)
    return int(np.clip(np.log(SPREAD) / apart if apart > 0 else 12, 2, 12))


def leading_components(times: Callable[[np.ndarray], np.ndarray], dims: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling; those without variance left out) and their unit vectors of a covariance given
    by its product with a basis."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((dims, min(dims, k + GUARD))))[0]
    vq, best, worse = times(q), np.inf, 0
    for _ in range(STEPS):
        values, q, vq = ritz(q, vq)
        if values[0] <= 0:
            return values[:0], q[:, :0]
        wanted = max(1, int((values[:k] > NO_VARIANCE * values.sum()).sum()))
        rest = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / values[0]
        worse = 0 if rest < best / 2 else worse + 1
        best = min(best, rest)
        cut = max(values[-1], 1e-8 * values[0])
        degree = filter_degree(values[0], values[wanted - 1], cut)
        settled = rest <= RESIDUAL or (worse >= 3 and rest <= 1e-9)  # rounding of the passes may end it earlier
        if settled:
            missed = None if q.shape[1] == dims else probe(times, q[:, :wanted], values[wanted - 1], degree, rng)
            if missed is None:
                return values[:wanted], q[:, :wanted]
            q = np.linalg.qr(np.hstack([q[:, :wanted], missed, q[:, wanted:]]))[0][:, : q.shape[1]]
        else:
            q = np.linalg.qr(chebyshev(times, q, vq, cut, degree))[0]
        vq = times(q)
    raise ArithmeticError(f"residual {best:.1e} after {STEPS} steps")


def probe(times: Callable[[np.ndarray], np.ndarray], found: np.ndarray, least: float, degree: int, rng: np.random.Generator) -> np.ndarray | None:
    """Filtered random directions outside the found ones, if they hold a Ritz value above the least one found."""
    outside = lambda m: m - found @ (found.T @ m)
    q = np.linalg.qr(outside(rng.standard_normal((found.shape[0], min(8, found.shape[0] - found.shape[1])))))[0]
    q = np.linalg.qr(outside(chebyshev(lambda m: outside(times(m)), q, outside(times(q)), least, degree)))[0]
    values, q, _ = ritz(q, times(q))
    return q if values[0] > least * (1 + 1e-9) else None


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of rows (vec_id, embedding) and
    component. deviation is null beyond 64 bits."""
    spark = rows.sparkSession
    ship(spark)
    schema = f"vec_id {dict(rows.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = materialize(rows.select("vec_id", grid_vector(F.col("embedding")).alias("x")).where(F.col("x").isNotNull()), "whitening-rows")
    size = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), F.col("d").desc()).first()
    if size is None:
        return spark.createDataFrame([], schema)
    d = size["d"]
    vectors = vectors.where(F.size("x") == d)
    fit = FitList(vectors, d)
    values, basis = leading_components(fit.times, d, min(components, d)) if fit.trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], schema)
    to_white = basis / np.sqrt(values)

    centre = fit.centre

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ to_white
        both = np.zeros((k + 1, d))
        both[:k, :k], both[k, :k] = w.T @ w, w.sum(0)
        return both

    both = fit.total(moments, k + 1).T / fit.n
    error = float(np.abs(both[:k, :k] - np.outer(both[k, :k], both[k, :k]) - np.eye(k)).max())
    explained = values / fit.trace
    n = fit.n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                z = centre.deviations(next(matrices(iter([b]), d)))
                zf = z.astype(np.float64)
                if (zf * zf).sum(1).max() < 9e18:
                    square = (z.astype(np.int64) ** 2).sum(1).tolist()
                else:
                    square = [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in r) for r in z)]
                w, m = (zf / n) @ to_white, b.num_rows
                cols = [
                    b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                    pa.array(square, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(work, schema)
