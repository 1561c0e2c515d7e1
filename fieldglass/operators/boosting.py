"""Boosted regression trees for counts: Spark adds up gradients by node, feature and bin; only those histograms leave the tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from fieldglass.sources.scratch import stored

#: Rates outside these are not scores. Fixed values.
LEAST_RATE, MOST_RATE = 0.1, 5.0


@dataclass(frozen=True)
class Settings:
    trees: int = 60
    depth: int = 2
    rate: float = 0.15
    bins: int = 32
    #: Added to a leaf's weight; least weight of a leaf; trees without a better validation deviance before the end.
    ridge: float = 1.0
    least: float = 5.0
    patience: int = 6


@dataclass
class Tree:
    """A whole binary tree as arrays: node k has the children 2k+1 and 2k+2, bins up to `at` go left. A node that is not split sends all left."""

    feature: np.ndarray
    at: np.ndarray
    leaf: np.ndarray

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels."""
        node = np.zeros(len(bins), int)
        for _ in range(levels):
            node = 2 * node + 1 + (bins[np.arange(len(bins)), self.feature[node]] > self.at[node])
        return node


@dataclass
class Model:
    features: tuple[str, ...]
    edges: list[np.ndarray]
    depth: int
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    gains: list[np.ndarray] = field(default_factory=list)
    #: Mean deviance after each number of trees: of the rows fitted on, and of the validation rows.
    deviances: list[tuple[float, float]] = field(default_factory=list)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for tree in self.trees:
            out += tree.leaf[tree.place(bins, self.depth) - (2**self.depth - 1)]
        return out

    def importance(self) -> dict[str, float]:
        """Each feature's share of the gain of all splits."""
        total = np.sum(self.gains, axis=0) if self.gains else np.zeros(len(self.features))
        return dict(zip(self.features, (total / total.sum() if total.sum() > 0 else total).tolist()))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin 0 holds missing values, the others rise with the value."""
    out = np.zeros(x.shape, int)
    for j, e in enumerate(edges):
        known = ~np.isnan(x[:, j])
        out[known, j] = 1 + np.searchsorted(e, x[known, j], side="left")
    return out


def quantile_edges(rows: DataFrame, features: tuple[str, ...], bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of each feature, from one pass of mergeable quantile summaries."""
    at = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.nullif(F.col(f).cast("double"), F.lit(float("nan"))), at, 10_000).alias(f"q{j}") for j, f in enumerate(features)]).first()
    return [np.unique(np.array(q if q is not None else [], float)) for q in found]


def best_splits(g: np.ndarray, h: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of histograms (node, feature, bin): feature, bin and gain of each node's best split, and (node, side) sums of (g, h). No gain: bin is the last."""
    gl, hl = g.cumsum(2), h.cumsum(2)
    gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
    score = lambda a, b: a * a / (b + settings.ridge)
    gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
    gain = np.where((hl >= settings.least) & (ht - hl >= settings.least), gain, 0.0)
    nodes, _, bins = g.shape
    flat = gain.reshape(nodes, -1)
    best = flat.argmax(1)
    gains = flat[np.arange(nodes), best]
    feature, at = np.where(gains > 1e-9, best // bins, 0), np.where(gains > 1e-9, best % bins, bins - 1)
    rows = np.arange(nodes)
    left = np.stack((gl[rows, feature, at], hl[rows, feature, at]), 1)
    whole = np.stack((gt[:, 0, 0], ht[:, 0, 0]), 1)
    return feature, at, np.where(gains > 1e-9, gains, 0.0), np.stack((left, whole - left), 1)


def _pass(binned_rows: DataFrame, model: Model, grown: Tree | None, level: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradients, weights) by node, feature and bin of one level, and [rows, deviance] of fitted and validation rows."""
    count = len(model.features)
    nodes, first = 2**level, 2**level - 1
    size = nodes * count * width

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * size + 4)
        for frame in frames:
            bins, y, valid = np.array(frame["bins"].tolist()).reshape(len(frame), count), frame["y"].to_numpy(), frame["valid"].to_numpy(bool)
            margin = model.margin(bins)
            mu = np.exp(margin)
            deviance = 2 * (np.where(y > 0, y * (np.log(np.maximum(y, 1e-300)) - margin), 0.0) - (y - mu))
            for k, own in enumerate((~valid, valid)):
                total[2 * size + 2 * k :][:2] += own.sum(), deviance[own].sum()
            bins, slope, weight = bins[~valid], (y - mu)[~valid], mu[~valid]
            node = grown.place(bins, level) - first if grown else np.zeros(len(bins), int)
            for j in range(count):
                at = (node * count + j) * width + bins[:, j]
                total[:size] += np.bincount(at, slope, size)
                total[size : 2 * size] += np.bincount(at, weight, size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": at, "v": total[at]})

    out = np.zeros(2 * size + 4)
    for i, v in binned_rows.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    shape = (nodes, count, width)
    return out[:size].reshape(shape), out[size : 2 * size].reshape(shape), out[2 * size :].reshape(2, 2)


def fit(rows: DataFrame, features: tuple[str, ...], y: str, valid: Column, settings: Settings = Settings()) -> Model:
    """Trees on `features` for the counts `y`, grown on the rows where `valid` does not hold, as many as serve those where it does.

    Rows without y are left out; a missing feature has a bin of its own. Bins are fitted and the rows binned and written
    once; every level of a tree is one pass. Rows are never collected: the driver sees sums by node, feature and bin.
    Without validation rows all trees stay. Without rows to fit on there is no tree and the rate is 1.
    """
    known = rows.where(F.col(y).isNotNull()).withColumn("_valid", F.coalesce(valid, F.lit(False)))
    edges = quantile_edges(known.where(~F.col("_valid")), features, settings.bins)
    listed = F.array(*[F.col(f).cast("double") for f in features])

    @pandas_udf("array<int>")
    def cut(x: pd.Series) -> pd.Series:
        return pd.Series(list(binned(np.array(x.tolist(), float).reshape(len(x), len(features)), edges)))

    table = stored(known.select(cut(listed).alias("bins"), F.col(y).cast("double").alias("y"), F.col("_valid").alias("valid")), "boosting")
    mean = table.where("not valid").agg(F.avg("y")).first()[0]
    model = Model(features, edges, settings.depth, float(np.log(max(mean or 1.0, 1e-3))))
    width, best, kept = settings.bins + 1, np.inf, 0
    for _ in range(settings.trees):
        inner = 2**settings.depth - 1
        tree, gains = Tree(np.zeros(inner, int), np.full(inner, width - 1), np.zeros(inner + 1)), np.zeros(len(features))
        for level in range(settings.depth):
            g, h, seen = _pass(table, model, tree if level else None, level, width)
            if not level:
                model.deviances.append(tuple((seen[:, 1] / np.maximum(seen[:, 0], 1)).tolist()))
                if seen[1, 0] and model.deviances[-1][1] < best - 1e-12:
                    best, kept = model.deviances[-1][1], len(model.trees)
                if not seen[0, 0] or seen[1, 0] and len(model.trees) - kept >= settings.patience:
                    model.trees, model.gains = model.trees[:kept], model.gains[:kept]
                    return model
            feature, at, gain, sides = best_splits(g, h, settings)
            nodes = 2**level - 1 + np.arange(2**level)
            tree.feature[nodes], tree.at[nodes] = feature, at
            np.add.at(gains, feature, gain)
            # an empty side has the sums (0, 0) and so a leaf of 0: no row of these gets there
            tree.leaf = settings.rate * (sides[..., 0] / (sides[..., 1] + settings.ridge)).reshape(-1)
        model.trees.append(tree)
        model.gains.append(gains)
    seen = _pass(table, model, None, 0, width)[2]
    model.deviances.append(tuple((seen[:, 1] / np.maximum(seen[:, 0], 1)).tolist()))
    if seen[1, 0] and model.deviances[-1][1] >= best - 1e-12:
        model.trees, model.gains = model.trees[:kept], model.gains[:kept]
    return model


def rates(model: Model, rows: DataFrame, into: str = "rate") -> DataFrame:
    """rows with the model's rate, held between LEAST_RATE and MOST_RATE; a missing feature goes where missing ones went."""

    @pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        at = binned(np.array(x.tolist(), float).reshape(len(x), len(model.features)), model.edges)
        return pd.Series(np.clip(np.exp(model.margin(at)), LEAST_RATE, MOST_RATE))

    return rows.withColumn(into, run(F.array(*[F.col(f).cast("double") for f in model.features])))
