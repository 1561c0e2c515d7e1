"""Maximum-likelihood attack and defence strengths with corrected low scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

COUNTS = ("n", "hg", "ag", "n00", "n01", "n10", "n11")


def pair_scores(matches: DataFrame, by: str, decay: float = 0.0) -> DataFrame:
    """All that the likelihood needs of the played matches: one row per `by` and ordered pair of teams, however many matches.

    Each match counts exp(-decay * days before the last match).
    """
    played = matches.where("fthg is not null and ftag is not null")
    w = F.exp(-decay * F.datediff(F.max("match_date").over(W.partitionBy(by)), F.col("match_date"))) if decay else F.lit(1.0)
    at = lambda i, j: F.sum(F.when((F.col("fthg") == i) & (F.col("ftag") == j), F.col("w")).otherwise(0.0)).alias(f"n{i}{j}")
    sums = [F.sum("w").alias("n"), F.sum(F.col("w") * F.col("fthg")).alias("hg"), F.sum(F.col("w") * F.col("ftag")).alias("ag")]
    return played.withColumn("w", w).groupBy(by, "home_id", "away_id").agg(*sums, at(0, 0), at(0, 1), at(1, 0), at(1, 1))


class Design:
    """The matrix of the log rates, two rows a pair (the home side's, then the away side's), as places: a row holds its
    side's attack, the other's defence turned, the level, and the home edge if at home. Never spelt out, so memory grows with the pairs."""

    def __init__(self, h: np.ndarray, a: np.ndarray, teams: int):
        self.attack, self.defence, self.t, self.half = np.concatenate((h, a)), np.concatenate((a, h)), teams, len(h)

    def times(self, theta: np.ndarray) -> np.ndarray:
        out = theta[self.attack] - theta[self.t + self.defence] + theta[-2]
        out[: self.half] += theta[-1]
        return out

    def turned(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.attack, v, self.t), -np.bincount(self.defence, v, self.t), [v.sum(), v[: self.half].sum()]))

    def solve(self, weight: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """The least x with X'WX x = gradient, by conjugate gradients from zero, which never leave the span of the rows."""
        x, left = np.zeros(len(gradient)), gradient.copy()
        way, now = left.copy(), left @ left
        aim = max(now * 1e-22, (1e-14 * weight.sum()) ** 2)  # what rounding leaves
        for _ in range(1000):
            if not now > aim:
                break
            bent = self.turned(weight * self.times(way))
            curve = way @ bent
            if not curve > 0:
                break
            x, left = x + now / curve * way, left - now / curve * bent
            now, last = left @ left, now
            way = left + now / last * way
        return x


def _likelihood(x: Design, theta: np.ndarray, rho: float, c: dict) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood (minus infinity where a correction is not positive) and both sides' rates."""
    half = x.half
    log_rate = x.times(theta)
    h, a = np.exp(log_rate[:half]), np.exp(log_rate[half:])
    low = {"n00": 1 - h * a * rho, "n01": 1 + h * rho, "n10": 1 + a * rho, "n11": np.full(half, 1 - rho)}
    if any((v[c[k] > 0] <= 0).any() for k, v in low.items()):
        return -np.inf, h, a
    total = (c["hg"] * log_rate[:half] - c["n"] * h + c["ag"] * log_rate[half:] - c["n"] * a).sum()
    return float(total + sum((c[k][c[k] > 0] * np.log(v[c[k] > 0])).sum() for k, v in low.items())), h, a


def maximise(pairs: pd.DataFrame, steps: int = 200, tolerance: float = 1e-7) -> tuple[list, np.ndarray, np.ndarray, float, float, float, float, int]:
    """(teams, attack, defence, level, home edge, rho, log-likelihood, steps) of one table of pairs.

    Fisher scoring for the log rates, Newton for rho, each step halved until the likelihood grows. Attack and defence
    have mean zero.
    """
    teams = sorted(set(pairs["home_id"]) | set(pairs["away_id"]))
    place, t, half = {k: i for i, k in enumerate(teams)}, len(teams), len(pairs)
    h, a = pairs["home_id"].map(place).to_numpy(), pairs["away_id"].map(place).to_numpy()
    c = {k: pairs[k].to_numpy(float) for k in COUNTS}
    x = Design(h, a, t)
    theta, rho = np.zeros(2 * t + 2), 0.0
    theta[-2] = np.log((c["hg"].sum() + c["ag"].sum()) / (2 * c["n"].sum()))
    best, lam, mu = _likelihood(x, theta, rho, c)
    for step in range(1, steps + 1):
        d00 = c["n00"] * lam * mu * rho / (1 - lam * mu * rho)
        slope = np.concatenate([c["hg"] - c["n"] * lam - d00 + c["n01"] * lam * rho / (1 + lam * rho), c["ag"] - c["n"] * mu - d00 + c["n10"] * mu * rho / (1 + mu * rho)])
        gradient = x.turned(slope)
        weight = np.concatenate([c["n"] * lam, c["n"] * mu])
        terms = [(c["n00"], -lam * mu), (c["n01"], lam), (c["n10"], mu), (c["n11"], -np.ones(half))]
        first = sum((n * k / (1 + k * rho)).sum() for n, k in terms)
        second = sum((n * k * k / (1 + k * rho) ** 2).sum() for n, k in terms)
        if max(np.abs(gradient).max(), abs(first)) < tolerance * max(1.0, c["n"].sum()):
            break
        move = x.solve(weight, gradient)
        for d_theta, d_rho in ((move, 0.0), (0.0 * move, first / second if second > 0 else 0.0)):
            size = 1.0
            while size > 1e-8:
                value, new_lam, new_mu = _likelihood(x, theta + size * d_theta, rho + size * d_rho, c)
                if value >= best:
                    theta, rho, best, lam, mu = theta + size * d_theta, rho + size * d_rho, value, new_lam, new_mu
                    break
                size /= 2
    attack, defence = theta[:t], theta[t : 2 * t]
    return teams, attack - attack.mean(), defence - defence.mean(), float(theta[-2] + attack.mean() - defence.mean()), float(theta[-1]), rho, best, step


def fit(matches: DataFrame, by: str = "season", decay: float = 0.0) -> DataFrame:
    """Per `by` and team: attack, defence, and the league's level, home_edge, rho, log_likelihood, steps, status.

    log(home goals) = level + home_edge + attack(home) - defence(away), without the edge for the other side. Spark sums
    the matches to pairs of teams; a fit sees those (teams squared at most). A season in which a team never scored or
    never conceded has no finite maximum: its rows have status "separated" and nulls. Nulls in `by` are a group.
    """
    kind = matches.schema[by].dataType.simpleString()

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        teams = sorted(set(pairs["home_id"]) | set(pairs["away_id"]))
        scored = pairs.groupby("home_id")["hg"].sum().reindex(teams, fill_value=0) + pairs.groupby("away_id")["ag"].sum().reindex(teams, fill_value=0)
        conceded = pairs.groupby("home_id")["ag"].sum().reindex(teams, fill_value=0) + pairs.groupby("away_id")["hg"].sum().reindex(teams, fill_value=0)
        out = pd.DataFrame({by: pairs[by].iloc[0], "team": teams})
        if not ((scored > 0) & (conceded > 0)).all():
            return out.assign(attack=None, defence=None, level=None, home_edge=None, rho=None, log_likelihood=None, steps=0, status="separated")
        _, attack, defence, level, edge, rho, best, steps = maximise(pairs)
        return out.assign(attack=attack, defence=defence, level=level, home_edge=edge, rho=rho, log_likelihood=best, steps=steps, status="fitted")

    return pair_scores(matches, by, decay).groupBy(by).applyInPandas(run, f"{by} {kind}, team int, attack double, defence double, level double, home_edge double, rho double, log_likelihood double, steps int, status string")
