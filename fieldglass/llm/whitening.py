"""Embedding whitening: distributed centred covariance, leading eigenpairs of its tridiagonal form, broadcast projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import stored

#: Steps of a unit.
SCALE = 256
EPS = np.finfo(float).eps
#: Partial matrices are added up in so many groups, then as one.
FAN = 64


# eigenpairs of a symmetric matrix


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal a, off-diagonal b, q) with v = q T q', by Householder reflections."""
    t, q = v.copy(), np.eye(len(v))
    for k in range(len(v) - 2):
        x = t[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size == 0:
            continue
        u = x / size
        t[k + 1 :, k:] -= 2 * np.outer(u, u @ t[k + 1 :, k:])
        t[k:, k + 1 :] -= 2 * np.outer(t[k:, k + 1 :] @ u, u)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    return np.diag(t).copy(), np.diag(t, -1).copy(), q


def below(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix lie below each x."""
    tiny = np.finfo(float).tiny * max(1.0, float((b * b).max(initial=0.0)))
    count, pivot = np.zeros(len(x), int), np.ones(len(x))
    for k in range(len(a)):
        pivot = a[k] - x - (b[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each by bisection on the Sturm count."""
    around = np.abs(np.concatenate((b, [0.0]))) + np.abs(np.concatenate(([0.0], b)))
    span = max(float((a + around).max()) - float((a - around).min()), 1e-300)
    low, high = np.full(k, (a - around).min() - EPS * span), np.full(k, (a + around).max() + EPS * span)
    at_least = len(a) - 1 - np.arange(k)  # so many lie below the j-th largest
    for _ in range(400):
        mid = (low + high) / 2
        if np.all((mid <= low) | (mid >= high)):
            break
        beneath = below(a, b, mid) <= at_least
        low, high = np.where(beneath, mid, low), np.where(beneath, high, mid)
    return (low + high) / 2


def _factor(a: np.ndarray, b: np.ndarray, value: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - value) z = y by elimination with row exchanges; pivots of zero become tiny ones."""
    n, least = len(a), EPS * max(float(np.abs(a).max()), float(np.abs(b).max(initial=0.0)), np.finfo(float).tiny)
    main, upper, second = a - value, np.append(b, 0.0), np.zeros(n)
    swapped, factors = np.zeros(n, bool), np.zeros(n)
    for k in range(n - 1):
        lower = b[k]
        if abs(lower) > abs(main[k]):
            swapped[k] = True
            main[k], lower = lower, main[k]
            upper[k], main[k + 1] = main[k + 1], upper[k]
            second[k], upper[k + 1] = upper[k + 1], 0.0
        elif abs(main[k]) < least:
            main[k] = least
        factors[k] = lower / main[k]
        main[k + 1] -= factors[k] * upper[k]
        upper[k + 1] -= factors[k] * second[k]
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(y: np.ndarray) -> np.ndarray:
        z = y.copy()
        for k in range(n - 1):
            if swapped[k]:
                z[k], z[k + 1] = z[k + 1], z[k]
            z[k + 1] -= factors[k] * z[k]
        for k in range(n - 1, -1, -1):
            rest = (upper[k] * z[k + 1] if k + 1 < n else 0.0) + (second[k] * z[k + 2] if k + 2 < n else 0.0)
            z[k] = (z[k] - rest) / main[k]
        return z

    return solve


def leading_pairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the symmetric v and their unit vectors as rows; a vector's largest entry is positive."""
    k, size = min(k, len(v)), float(np.abs(v).max(initial=0.0))
    if size == 0:
        return np.zeros(k), np.eye(len(v))[:k]
    a, b, q = tridiagonal(v / size)
    values, norm = leading_values(a, b, k), float(np.abs(a).max() + 2 * np.abs(b).max(initial=0.0))
    rng, found = np.random.default_rng(11), []
    for j, value in enumerate(values):
        # equal eigenvalues get shifts of their own, and their vectors are kept at right angles
        cluster = [i for i in range(j) if values[i] - value <= 1e-3 * norm]
        solve, z = _factor(a, b, value - 4 * EPS * norm * len(cluster)), rng.standard_normal(len(a))
        for _ in range(6):
            z = solve(z / np.abs(z).max())
            for _ in range(2):
                for i in cluster:
                    z -= (found[i] @ z) * found[i]
            z /= np.linalg.norm(z)
        found.append(z)
    vectors = np.array(found) @ q.T
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    top = np.abs(vectors).argmax(1)
    return values * size, vectors * np.sign(vectors[np.arange(k), top])[:, None]


# sums over the fit list


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector holds only finite entries."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False)))


def steps(column: str = "embedding") -> Column:
    """floor(256 c) of each entry; beyond the range of a long it is the range's end."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def _by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The vectors x of each batch as matrices, one for each length that occurs."""
    for batch in batches:
        x = batch.column("x")
        sizes = x.value_lengths().to_numpy(zero_copy_only=False)
        flat, ends = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            yield flat[(ends[rows] - d)[:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for x in _by_size(batches):
        d = x.shape[1]
        exact = x if len(x) * np.abs(x.astype(float)).max() < 2.0**62 else x.astype(object)
        n[d] = n.get(d, 0) + len(x)
        sums[d] = sums.get(d, np.zeros(d, object)) + exact.sum(0).astype(object)
    listed = [[Decimal(int(s)) for s in sums[d]] for d in n]
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(n.values(), pa.int64()), pa.array(listed, pa.list_(pa.decimal128(38, 0)))], ["size", "n", "sums"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums/n: whole parts exactly, then the fractions."""
    whole = [s // n for s in sums]
    fraction = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    fits = max(map(abs, whole)) < 2**61 and np.abs(x.astype(float)).max(initial=0.0) < 2.0**61
    moved = (x - np.array(whole)).astype(float) if fits else (x.astype(object) - np.array(whole, object)).astype(float)
    return moved - fraction


def _products(made: Callable[[np.ndarray], np.ndarray]):
    """Sums of the products of the columns that `made` gives for a matrix of vectors, a row for each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for x in _by_size(batches):
            y, d = made(x), x.shape[1]
            total[d] = total.get(d, 0) + y.T @ y
        part = TaskContext.get().partitionId() % FAN
        rows = [(d, i, part, row) for d, m in total.items() for i, row in enumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64())))], ["size", "i", "part", "row"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.iloc[:1].assign(row=[np.sum(rows["row"].tolist(), axis=0)])


def products(listed: DataFrame, made: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """The summed matrices by length of the vectors: partial ones in the tasks, added up in two steps."""
    parts = listed.mapInArrow(_products(made), "size int, i int, part int, row array<double>")
    for keys in (["size", "i", "part"], ["size", "i"]):
        parts = parts.groupBy(*keys).applyInPandas(_added, parts.schema)
    rows: dict[int, dict[int, list[float]]] = {}
    for r in parts.collect():  # as many numbers as a covariance has
        rows.setdefault(r["size"], {})[r["i"]] = r["row"]
    return {d: np.array([m[i] for i in sorted(m)]) for d, m in rows.items()}


@dataclass
class Model:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    #: Which components have any variance beyond rounding.
    live: np.ndarray
    identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The vectors' live components, of variance 1 over the fit list."""
        return centred(x, self.n, self.sums) @ (self.vectors[self.live] / np.sqrt(self.values[self.live])[:, None]).T


def fit(vectors: DataFrame, components: int = 4, column: str = "embedding") -> dict[int, Model]:
    """A model for each length of vector that occurs, over the distinct x of all usable rows.

    Nothing is sampled: the counts and sums are exact, the covariance is centred before it is multiplied, and the
    identity error is that of the whitened fit list itself. The driver holds one matrix of a covariance's size for each
    length. A table without usable rows has no model.
    """
    listed = stored(usable(vectors, column).select(steps(column).alias("x")).where(F.size("x") > 0).distinct())
    sums = listed.mapInArrow(_sums, "size int, n long, sums array<decimal(38,0)>")
    summed = sums.select("size", "n", F.posexplode("sums").alias("i", "s")).groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("size", "i").collect()
    totals: dict[int, tuple[int, list[int]]] = {}
    for r in summed:
        totals.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    models = {}
    for d, m in products(listed, lambda x: centred(x, *totals[x.shape[1]])).items():
        n, s = totals[d]
        v = (m + m.T) / (2 * n)
        values, found = leading_pairs(v, components)
        trace = float(np.trace(v))
        live = values > d * EPS * max(trace, 0.0)
        models[d] = Model(n, s, values, found, values / trace if trace > 0 else np.full(len(values), np.nan), live)
    means = {d: np.zeros(m.live.sum()) for d, m in models.items()}

    def padded(x: np.ndarray) -> np.ndarray:
        y = models[x.shape[1]].whitened(x)
        return np.hstack((np.ones((len(y), 1)), y))

    for d, m in products(listed, padded).items():
        means[d] = m[0, 1:] / m[0, 0]
    for d, m in products(listed, lambda x: models[x.shape[1]].whitened(x) - means[x.shape[1]]).items():
        models[d].identity_error = float(np.abs(m / models[d].n - np.eye(len(m))).max()) if len(m) else None
    return models


def _deviations(x: np.ndarray, model: Model) -> list[Decimal | None]:
    """Sums of (n x - S)^2, exact; None beyond 38 digits."""
    far = model.n * np.abs(x.astype(float)).max(initial=0.0) + max(map(abs, model.sums))
    fits = far * far * x.shape[1] < 2.0**62
    kind = np.int64 if fits else object
    apart = model.n * x.astype(kind) - np.array(model.sums, kind)
    return [Decimal(int(t)) if int(t) < 10**38 else None for t in (apart * apart).sum(1)]


def whiten(vectors: DataFrame, components: int = 4, column: str = "embedding") -> DataFrame:
    """A row for each usable row of vectors and each of its leading components: row (struct of the columns), component (from 1),
    n, deviation (decimal(38,0), null beyond it), whitened, explained, identity_error.

    Rows with a null vector or a null or non-finite entry go; repeated rows each keep theirs and count once in the fit list.
    Vectors of another length are whitened among themselves; those of fewer entries than `components` have as many
    components as entries, empty ones none. A component without variance (fewer distinct vectors than components, or
    equal ones) has null whitened, and identity_error covers the others; explained is null where all vectors are equal.
    An empty table gives an empty result; columns of any name stay apart in the struct.
    """
    models = fit(vectors, components, column)

    @pandas_udf("n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    def run(rows: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(rows)
        sizes = rows.map(len).to_numpy()
        for d in np.unique(sizes):
            at, model = np.flatnonzero(sizes == d), models[d]
            x = np.array(rows.iloc[at].tolist(), np.int64).reshape(len(at), d)
            y = np.full((len(at), len(model.values)), np.nan)
            y[:, model.live] = model.whitened(x)
            for i, deviation, made in zip(at, _deviations(x, model), y):
                out[i] = (model.n, deviation, made, model.explained, model.identity_error)
        return pd.DataFrame(out, columns=["n", "deviation", "whitened", "explained", "identity_error"])

    rows = usable(vectors, column).select(F.struct(*vectors.columns).alias("row"), steps(column).alias("x")).where(F.size("x") > 0)
    rows = rows.select("row", run("x").alias("made"))
    each = rows.select("row", "made", F.posexplode("made.whitened").alias("k", "value"))
    return each.select(
        "row", (F.col("k") + 1).alias("component"), "made.n", "made.deviation", F.nanvl("value", F.lit(None).cast("double")).alias("whitened"),
        F.nanvl(F.get("made.explained", F.col("k")), F.lit(None).cast("double")).alias("explained"), "made.identity_error",
    )
