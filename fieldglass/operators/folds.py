"""Models fitted without a season: every fit that is needed in one pass a step, and a second model on their forecasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fieldglass.sources.scratch import stored

#: Classes of an outcome; the first is the base class.
CLASSES = 3
Fit = tuple[str, ...]
Sums = tuple[float, np.ndarray, np.ndarray]


def poisson(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> Sums:
    """Log likelihood of counts under a log-linear rate, its gradient and minus its second derivative."""
    at = np.clip(x @ beta, -30, 30)
    rate = np.exp(at)
    return float(y @ at - rate.sum()), x.T @ (y - rate), (x * rate[:, None]).T @ x


def multinomial(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> Sums:
    """The same for the chances of the classes; beta holds a block for each class but the first."""
    p = x.shape[1]
    at = np.hstack((np.zeros((len(x), 1)), x @ beta.reshape(-1, p).T))
    at -= at.max(1, keepdims=True)
    chance = np.exp(at) / np.exp(at).sum(1, keepdims=True)
    hit = np.eye(CLASSES)[y.astype(int)]
    blocks = [[(x * (chance[:, i] * ((i == j) - chance[:, j]))[:, None]).T @ x for j in range(1, CLASSES)] for i in range(1, CLASSES)]
    return float(np.log(np.maximum((chance * hit).sum(1), 1e-300)).sum()), ((hit - chance)[:, 1:].T @ x).ravel(), np.block(blocks)


FAMILIES = {"poisson": (poisson, 1), "multinomial": (multinomial, CLASSES - 1)}


@dataclass(frozen=True)
class Base:
    """A first-level model: what it looks at, what it forecasts, and how."""

    features: tuple[str, ...]
    y: str
    family: str

    def size(self) -> int:
        return (len(self.features) + 1) * FAMILIES[self.family][1]


def climb(evaluate: Callable[[dict[Fit, np.ndarray]], dict[Fit, Sums]], fits: list[Fit], size: int, ridge: float, steps: int) -> dict[Fit, np.ndarray]:
    """Newton's method for all fits at once; a step that makes a fit worse is halved. Each call of `evaluate` is one pass over the rows."""
    held, trial, best = {k: np.zeros(size) for k in fits}, {k: np.zeros(size) for k in fits}, {k: -np.inf for k in fits}
    open_ = set(fits)
    for _ in range(steps):
        if not open_:
            break
        for key, (value, slope, curve) in evaluate({k: trial[k] for k in fits if k in open_}).items():
            value, slope, curve = value - ridge / 2 * float(trial[key] @ trial[key]), slope - ridge * trial[key], curve + ridge * np.eye(size)
            if value < best[key] - 1e-10 * abs(best[key]):
                trial[key] = (trial[key] + held[key]) / 2
                continue
            held[key], best[key] = trial[key], value
            if np.abs(slope).max() < 1e-7 * max(1.0, float(np.abs(np.diag(curve)).max())):
                open_.discard(key)
            else:
                trial[key] = held[key] + np.linalg.solve(curve, slope)
    return held


def _summed(rows: DataFrame, sums: Callable[[pd.DataFrame], Iterator[tuple[int, Sums]]], fits: list[Fit], size: int) -> dict[Fit, Sums]:
    """What `sums` gives for each fit, added up over all rows: tasks add their own, Spark adds theirs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for k, (value, slope, curve) in sums(frame):
                total[k] = total.get(k, 0.0) + np.concatenate(([value], slope, curve.ravel()))
        yield pd.DataFrame({"k": list(total), "sums": [t.tolist() for t in total.values()]}, columns=["k", "sums"])

    parts = rows.mapInPandas(run, "k int, sums array<double>").select("k", F.posexplode("sums").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    out = np.zeros((len(fits), 1 + size + size * size))
    for k, i, v in parts.collect():  # as many numbers as the fits' curves hold
        out[k, i] = v
    return {key: (float(o[0]), o[1 : 1 + size], o[1 + size :].reshape(size, size)) for key, o in zip(fits, out)}


def _prepared(rows: DataFrame, bases: list[Base], y: str, fold: str) -> DataFrame:
    """x0, x1, ... (features of each base and a one), t0, t1, ... (what they forecast), y, fold: rows without a gap, written once."""
    known = [c for b in bases for c in (*b.features, b.y)] + [y]
    whole = rows.where(F.col(fold).isNotNull()).dropna(subset=list(dict.fromkeys(known)))
    columns = [F.array(*[F.col(c).cast("double") for c in b.features], F.lit(1.0)).alias(f"x{i}") for i, b in enumerate(bases)]
    return stored(whole.select(*columns, *[F.col(b.y).cast("double").alias(f"t{i}") for i, b in enumerate(bases)], F.col(y).cast("double").alias("y"), F.col(fold).cast("string").alias("fold")), "folds")


def _base_fits(prepared: DataFrame, i: int, base: Base, fits: list[Fit], ridge: float, steps: int) -> dict[Fit, np.ndarray]:
    family, _ = FAMILIES[base.family]

    def evaluate(betas: dict[Fit, np.ndarray]) -> dict[Fit, Sums]:
        keys = list(betas)

        def sums(frame: pd.DataFrame) -> Iterator[tuple[int, Sums]]:
            x, y, fold = np.array(frame["x"].tolist()), frame["t"].to_numpy(), frame["fold"].to_numpy()
            for k, key in enumerate(keys):
                use = ~np.isin(fold, key)
                if use.any():
                    yield k, family(x[use], y[use], betas[key])

        return _summed(prepared.select(F.col(f"x{i}").alias("x"), F.col(f"t{i}").alias("t"), "fold"), sums, keys, base.size())

    return climb(evaluate, fits, base.size(), ridge, steps)


def _linear(beta: Column, x: Column, block: int, width: int) -> Column:
    """A block of a fit's coefficients times a row's features."""
    return F.aggregate(F.zip_with(F.slice(beta, block * width + 1, width), x, lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v)


def _by_fold(fits: dict[str, np.ndarray], fold: str) -> Column:
    """The coefficients of the fit that a row's fold names."""
    return F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v.tolist())) for pair in fits.items() for v in pair])[F.col(fold).cast("string")]


def _scores(base: Base, beta: Column) -> list[Column]:
    """Log rate, or log odds against the first class, by a base model."""
    width, x = len(base.features) + 1, F.array(*[F.col(c).cast("double") for c in base.features], F.lit(1.0))
    return [_linear(beta, x, block, width) for block in range(FAMILIES[base.family][1])]


def chances(at: list[Column]) -> list[Column]:
    """The classes' chances from their log odds against the first."""
    top = F.greatest(F.lit(0.0), *at)
    parts = [F.exp(-top), *[F.exp(a - top) for a in at]]
    return [part / sum(parts[1:], parts[0]) for part in parts]


def season_forecasts(rows: DataFrame, base: Base, fold: str, ridge: float = 1e-4, steps: int = 25) -> DataFrame:
    """rows with the forecast of a model fitted on all other folds: `rate`, or p_0, p_1, p_2.

    All folds are fitted together: a step is one pass over the rows, in which each row counts for every fold but its
    own, and only the fits' sums leave the tasks. A row that lacks y is scored like any other; one that lacks a feature
    or its fold has no forecast; a fold alone is scored by the start values. Folds are few (seasons): one fit each on the driver.
    """
    names = sorted(r[0] for r in rows.select(F.col(fold).cast("string")).where(F.col(fold).isNotNull()).distinct().collect())
    if not names:
        return rows.withColumns({n: F.lit(None).cast("double") for n in (["rate"] if base.family == "poisson" else [f"p_{k}" for k in range(CLASSES)])})
    fits = _base_fits(_prepared(rows, [base], base.y, fold), 0, base, [(n,) for n in names], ridge, steps)
    beta = _by_fold({k[0]: v for k, v in fits.items()}, fold)
    at = _scores(base, beta)
    return rows.withColumn("rate", F.exp(at[0])) if base.family == "poisson" else rows.withColumns({f"p_{k}": p for k, p in enumerate(chances(at))})


def stacked(rows: DataFrame, bases: list[Base], y: str, fold: str, ridge: float = 1e-2, steps: int = 25) -> DataFrame:
    """rows with p_0, p_1, p_2: a second model on the base models' scores, no part of which saw the row's fold.

    The second model that scores fold s is fitted on the other folds' rows, each with base scores from fits without
    both s and its own fold. So a base model is fitted once for each fold and each pair of folds, all in one pass a
    step; the rows are never copied by fold. Rows without y are scored; rows that lack a feature have nulls.
    """
    names = sorted(r[0] for r in rows.select(F.col(fold).cast("string")).where(F.col(fold).isNotNull()).distinct().collect())
    prepared = _prepared(rows, bases, y, fold)
    wanted = [(n,) for n in names] + list(combinations(names, 2))
    fitted = [_base_fits(prepared, i, b, wanted, ridge, steps) for i, b in enumerate(bases)]
    blocks = [FAMILIES[b.family][1] for b in bases]
    size = (sum(blocks) + 1) * (CLASSES - 1)

    def evaluate(betas: dict[Fit, np.ndarray]) -> dict[Fit, Sums]:
        keys = list(betas)

        def sums(frame: pd.DataFrame) -> Iterator[tuple[int, Sums]]:
            y, own = frame["y"].to_numpy(), frame["fold"].to_numpy()
            x = [np.array(frame[f"x{i}"].tolist()) for i in range(len(bases))]
            for k, (out,) in enumerate(keys):
                for t in set(own) - {out}:
                    at = own == t
                    pair = (min(out, t), max(out, t))
                    scores = [x[i][at] @ fitted[i][pair].reshape(blocks[i], -1).T for i in range(len(bases))]
                    yield k, multinomial(np.hstack([*scores, np.ones((at.sum(), 1))]), y[at], betas[out,])

        return _summed(prepared, sums, keys, size)

    second = climb(evaluate, [(n,) for n in names], size, ridge, steps)
    scores = [s for i, b in enumerate(bases) for s in _scores(b, _by_fold({n: fitted[i][n,] for n in names}, fold))]
    named = {f"_s{i}": s for i, s in enumerate(scores)}
    beta, x = _by_fold({n: second[n,] for n in names}, fold), F.array(*[F.col(n) for n in named], F.lit(1.0))
    at = [_linear(beta, x, block, len(named) + 1) for block in range(CLASSES - 1)]
    return rows.withColumns(named).withColumns({f"p_{k}": p for k, p in enumerate(chances(at))}).drop(*named)
