"""Probabilities, prices and stakes as column expressions."""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window as W, functions as F
from pyspark.sql.functions import pandas_udf


def poisson(rate: Column, k: int | Column) -> Column:
    fact = F.lit(float(factorial(k))) if isinstance(k, int) else F.factorial(k).cast("double")
    return F.exp(-rate) * F.pow(rate, F.lit(k) if isinstance(k, int) else k) / fact


def low_score_factor(i: Column, j: Column, home: Column, away: Column, rho: Column) -> Column:
    """Correction of the four lowest scores for their dependence."""
    return (
        F.when((i == 0) & (j == 0), 1 - home * away * rho)
        .when((i == 0) & (j == 1), 1 + home * rho)
        .when((i == 1) & (j == 0), 1 + away * rho)
        .when((i == 1) & (j == 1), 1 - rho)
        .otherwise(F.lit(1.0))
    )


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def soft_clip(x: Column, bound: float) -> Column:
    return bound * F.tanh(x / bound)


def proportional(price: Column, keys: list[str]) -> Column:
    """Fair probability of an outcome: its inverse price over the market's sum of inverse prices."""
    return (1 / price) / F.sum(1 / price).over(W.partitionBy(*keys))


def _shin(q: np.ndarray, z: np.ndarray, total: np.ndarray) -> np.ndarray:
    return (np.sqrt(z * z + 4 * (1 - z) * q * q / total) - z) / (2 * (1 - z))


#: Per method: bounds of its one parameter, and fair probabilities from inverse prices, the parameter and their sum.
_METHODS = {"power": (0.5, 10.0, lambda q, k, total: q**k), "shin": (0.0, 0.4, _shin)}


def devig(inverse: Column, method: str = "proportional", steps: int = 60) -> Column:
    """Array of fair probabilities from an array of inverse prices.

    "power" raises the inverse prices to one exponent, "shin" takes out a share of informed bettors; either parameter is
    bisected until the probabilities add up to 1, for a batch of markets at once. Null arrays stay null.
    """
    if method == "proportional":
        total = F.aggregate(inverse, F.lit(0.0), lambda s, q: s + q)
        return F.transform(inverse, lambda q: q / total)
    low, high, share = _METHODS[method]

    @pandas_udf("array<double>")
    def run(markets: pd.Series) -> pd.Series:
        sizes = markets.map(lambda m: 0 if m is None else len(m)).to_numpy()
        q = np.zeros((len(markets), max(1, sizes.max(initial=0))))
        there = np.arange(q.shape[1]) < sizes[:, None]
        q[there] = np.concatenate([np.asarray(m, float) for m in markets if m is not None] or [np.zeros(0)])
        total = np.where(sizes > 0, q.sum(1), 1.0)[:, None]
        lo, hi = np.full((len(q), 1), low), np.full((len(q), 1), high)
        for _ in range(steps):
            middle = (lo + hi) / 2
            up = np.where(there, share(q, middle, total), 0).sum(1, keepdims=True) > 1
            lo, hi = np.where(up, middle, lo), np.where(up, hi, middle)
        p = share(q, (lo + hi) / 2, total)
        return pd.Series([None if m is None else p[i, : sizes[i]] for i, m in enumerate(markets)])

    return run(inverse)


def with_margin(p: Column, margin: Column | float) -> Column:
    """Price of a fair probability in a market of that margin."""
    return 1 / (p * (1 + margin))


def kelly(p: Column, price: Column, cap: float = 0.05, least_edge: float = 0.0) -> Column:
    """Stake as a share of the bank; null without an edge."""
    f = ((price - 1) * p - (1 - p)) / (price - 1)
    return F.when((price > 1) & (f > 0) & (p * price - 1 >= least_edge), F.least(f, F.lit(cap)))


def tier(edge: Column, threshold: Column | float) -> Column:
    return F.when(edge >= 2.5 * threshold, "high").when(edge >= 1.5 * threshold, "medium").otherwise("low")


def entropy(parts: list[Column]) -> Column:
    """Nats; 0 if any part is 0."""
    total = F.lit(0.0)
    for p in parts:
        total -= p * F.log(p)
    zero = parts[0] <= 0
    for p in parts[1:]:
        zero |= p <= 0
    return F.when(zero, 0.0).otherwise(total)


def anytime_radius(n: Column, sd: Column, alpha: float = 0.05, rho: float = 0.1) -> Column:
    """Half width of an interval that holds at every sample size: infinite below 10, zero without spread."""
    r = F.lit(rho * rho)
    width = sd * F.sqrt(2 * (n * r + 1) / (n * n * r) * F.log(F.sqrt(n * r + 1) / alpha))
    return F.when(n < 10, F.lit(float("inf"))).when(sd == 0, 0.0).otherwise(width)


def blend_log(model: Column, market: Column, weight: float, cap: float = 0.5) -> Column:
    """Geometric blend: the market's log distance from the model, held within `cap`, counts by `weight`."""
    gap = F.greatest(F.lit(-cap), F.least(F.lit(cap), F.log(market / model)))
    return model * F.exp(weight * gap)
