"""Goal rates that a match's prices imply: weighted least squares on log total and log ratio, over all of its markets at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

#: Rates outside these are no football results; bounds of log total and of log ratio; worst residual of a usable fit. Fixed values.
LEAST, MOST = 0.15, 5.0
U, V = (np.log(0.6), np.log(7.0)), (-2.5, 2.5)
RESIDUAL = 0.35
#: Goals a side that the grid holds.
TOP = 10
#: Rows solved together.
BLOCK = 2048
OUT = "home double, away double, status string, residual double, constraints int, weight double"


def scores(home: np.ndarray, away: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """(row, i, j): chances of each score, low scores corrected, adding up to 1."""
    k = np.arange(TOP + 1)
    fact = np.cumprod(np.concatenate(([1.0], np.arange(1, TOP + 1))))
    pmf = lambda r: np.exp(-r)[:, None] * r[:, None] ** k / fact
    cells = pmf(home)[:, :, None] * pmf(away)[:, None, :]
    for i, j, factor in ((0, 0, 1 - home * away * rho), (0, 1, 1 + home * rho), (1, 0, 1 + away * rho), (1, 1, 1 - rho)):
        cells[:, i, j] = np.maximum(cells[:, i, j] * factor, 0.0)
    return cells / cells.sum((1, 2), keepdims=True)


def split(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total, share = np.exp(u), 1 / (1 + np.exp(-v))
    return total * share, total * (1 - share)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def modelled(u: np.ndarray, v: np.ndarray, rho: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """(row, constraint): log odds of a home win, of an away win, and of more goals than each line: as of scores(), by sums
    along one side's goals, without the grid."""
    home, away = split(u, v)
    steps = np.arange(1, TOP + 1)
    pmf = lambda r: np.exp(-r)[:, None] * np.cumprod(np.concatenate((np.ones((len(r), 1)), r[:, None] / steps), 1), 1)
    p, q = pmf(home), pmf(away)
    # q_tail[:, m]: the away side has m goals or more
    q_tail = np.concatenate((np.cumsum(q[:, ::-1], 1)[:, ::-1], np.zeros((len(q), 1))), 1)
    win = (p[:, 1:] * (q_tail[:, :1] - q_tail[:, 1 : TOP + 1])).sum(1)
    loss = (p * q_tail[:, 1:]).sum(1)
    total = p.sum(1) * q_tail[:, 0]
    least = np.clip(np.floor(lines).astype(int) + 1, 0, 2 * TOP + 1)
    over = np.zeros(lines.shape)
    for i in range(TOP + 1):
        over += p[:, i, None] * np.take_along_axis(q_tail, np.clip(least - i, 0, TOP + 1), 1)
    # low scores corrected
    for i, j, factor in ((0, 0, 1 - home * away * rho), (0, 1, 1 + home * rho), (1, 0, 1 + away * rho), (1, 1, 1 - rho)):
        more = p[:, i] * q[:, j] * (np.maximum(factor, 0.0) - 1)
        total, over = total + more, over + more[:, None] * (least <= i + j)
        win, loss = win + more * (i > j), loss + more * (i < j)
    return _logit(np.concatenate((win[:, None], loss[:, None], over), 1) / total[:, None])


def _bisected(low: float, high: float, n: int, higher) -> np.ndarray:
    a, b = np.full(n, low), np.full(n, high)
    for _ in range(40):
        mid = (a + b) / 2
        up = higher(mid)
        a, b = np.where(up, mid, a), np.where(up, b, mid)
    return (a + b) / 2


def solve(target: np.ndarray, weight: np.ndarray, lines: np.ndarray, rho: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home, away, whether the fit came to rest) of rows of log odds as modelled() gives them; a weight of 0 leaves a constraint out.

    Starts from the line nearest 2.5 as one Poisson total and from the ratio of the two wins, then damped Gauss-Newton
    steps inside the bounds, all rows at once.
    """
    n, at = len(target), np.arange(len(target))
    main = np.where(weight[:, 2:] > 0, np.abs(lines - 2.5), np.inf).argmin(1)
    wanted, line = 1 / (1 + np.exp(-target[at, 2 + main])), np.floor(lines[at, main])

    def over(total: np.ndarray) -> np.ndarray:
        k = np.arange(2 * TOP + 1)
        fact = np.cumprod(np.concatenate(([1.0], np.arange(1, 2 * TOP + 1))))
        return 1 - (np.exp(-total)[:, None] * total[:, None] ** k / fact * (k <= line[:, None])).sum(1)

    u = np.clip(np.log(np.maximum(_bisected(0.3, 7.0, n, lambda t: over(t) < wanted), 0.31)), *U)
    win, loss = (1 / (1 + np.exp(-target[:, c])) for c in (0, 1))

    def share(v: np.ndarray) -> np.ndarray:
        odds = modelled(u, v, rho, lines[:, :0])
        h, a = (1 / (1 + np.exp(-odds[:, c])) for c in (0, 1))
        return h / (h + a)

    v = _bisected(*V, n, lambda x: share(x) < win / (win + loss))
    done, rest, live = (u.copy(), v.copy()), np.zeros(n, bool), at
    gap = lambda u, v: np.where(weight[live] > 0, weight[live] * (modelled(u, v, rho[live], lines[live]) - target[live]), 0.0)
    now, damp = gap(u, v), np.full(n, 1e-3)
    for _ in range(rounds):
        if not len(live):
            break
        e = 1e-5
        j = np.stack(((gap(u + e, v) - gap(u - e, v)) / (2 * e), (gap(u, v + e) - gap(u, v - e)) / (2 * e)), 2)
        curve, slope = np.einsum("nci,ncj->nij", j, j), np.einsum("nci,nc->ni", j, now)
        curve = curve + damp[:, None, None] * np.einsum("nii->ni", curve)[:, :, None] * np.eye(2) + 1e-12 * np.eye(2)
        step = -np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        nu, nv = np.clip(u + step[:, 0], *U), np.clip(v + step[:, 1], *V)
        then = gap(nu, nv)
        better = (then * then).sum(1) <= (now * now).sum(1)
        moved = np.maximum(np.abs(nu - u), np.abs(nv - v))
        still = (moved < 1e-10) | ((damp > 1e8) & ~better)
        u, v, now = np.where(better, nu, u), np.where(better, nv, v), np.where(better[:, None], then, now)
        damp = np.where(better, np.maximum(damp / 10, 1e-12), damp * 10)
        done[0][live], done[1][live], rest[live] = u, v, still
        # rows at rest are left alone
        u, v, now, damp, live = u[~still], v[~still], now[~still], damp[~still], live[~still]
    return *split(*done), rest


def invert(rows: pd.DataFrame) -> pd.DataFrame:
    """home, away, status, residual, constraints, weight of rows (p_h, p_a, weight, dispersion, totals, rho, lead)."""
    n = len(rows)
    totals = [[t for t in x if t["p_over"] is not None] if x is not None else [] for x in rows["totals"]]
    wide = max([len(t) for t in totals] + [1])
    lines, target, weight = np.full((n, wide), 2.5), np.zeros((n, 2 + wide)), np.zeros((n, 2 + wide))
    pull = lambda w, d: w / np.maximum(d, 0.05)
    p = rows[["p_h", "p_a"]].to_numpy(float)
    there = ~np.isnan(p).any(1) & np.array([bool(t) for t in totals], bool)
    target[:, :2], weight[:, :2] = _logit(np.nan_to_num(p, nan=0.5)), pull(rows["weight"].to_numpy(float), rows["dispersion"].to_numpy(float))[:, None]
    best = np.zeros(n)
    for r, each in enumerate(totals):
        for c, t in enumerate(sorted(each, key=lambda t: t["line"])):
            lines[r, c], target[r, 2 + c], weight[r, 2 + c] = t["line"], _logit(np.array(t["p_over"])), pull(t["weight"], t["dispersion"])
            best[r] = max(best[r], t["weight"])
    out = pd.DataFrame({"home": np.nan, "away": np.nan, "status": "absent", "residual": np.nan, "constraints": 0, "weight": 0.0}, index=range(n))
    ok = np.flatnonzero(there)
    if len(ok):
        rho, lead = rows["rho"].to_numpy(float)[ok], rows["lead"].to_numpy(float)[ok]
        home, away, rest = solve(target[ok], weight[ok], lines[ok], rho)
        used = weight[ok] > 0
        off = np.where(used, modelled(np.log(home + away), np.log(home / away), rho, lines[ok]) - target[ok], 0.0)
        residual = np.sqrt((off * off).sum(1) / used.sum(1))
        status = np.where(rest & (residual <= RESIDUAL), "converged", "not_converged").astype(object)
        status[(home < LEAST) | (home > MOST) | (away < LEAST) | (away > MOST)] = "rejected_implausible_rate"
        turned = (np.abs(lead) > 0.5) & (np.abs(home - away) > 0.5) & (np.sign(home - away) != np.sign(lead)) & (status == "converged")
        status[turned] = "rejected_supremacy_sign"
        trust = np.where(status == "converged", rows["weight"].to_numpy(float)[ok] * best[ok], 0.0)
        for name, value in (("home", home), ("away", away), ("status", status), ("residual", residual), ("constraints", used.sum(1)), ("weight", trust)):
            out.loc[ok, name] = value
    return out


def market_rates(results: DataFrame, totals: DataFrame, rho: float = -0.05, leads: DataFrame | None = None) -> DataFrame:
    """match_id, home, away, status, residual, constraints, weight of each match in `results`.

    results: match_id, p_h, p_a, weight, dispersion (the books' consensus). totals: match_id, line, p_over, weight,
    dispersion, a row a line. leads: match_id, lead (our own home less away goals). The fit is in log odds, the
    draw is implied by the other two; each market pulls by its consensus weight over its dispersion (0.05 at least), so
    a single book gains nothing by having no one to differ from. weight is the results' times the best covered
    line's, and 0 unless converged. Statuses: absent (no results or no line), not_converged (no rest, or a residual over
    RESIDUAL in unweighted log odds), rejected_implausible_rate, rejected_supremacy_sign (a clear favourite on the other
    side than ours), converged.
    """
    each = totals.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("line", "p_over", "weight", "dispersion"))).alias("totals"))  # a match's few lines
    rows = results.join(each, "match_id", "left")
    rows = rows.join(leads.select("match_id", "lead"), "match_id", "left") if leads is not None else rows.withColumn("lead", F.lit(None).cast("double"))

    @pandas_udf(OUT)
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [invert(frame.iloc[at : at + BLOCK].reset_index(drop=True)) for at in range(0, len(frame), BLOCK)]
        return pd.concat(parts, ignore_index=True) if parts else invert(frame)

    fields = F.struct("p_h", "p_a", "weight", "dispersion", "totals", F.lit(rho).alias("rho"), F.coalesce("lead", F.lit(0.0)).alias("lead"))
    made = rows.select("match_id", run(fields).alias("m")).select("match_id", "m.*")
    blank = lambda c: F.nullif(c, F.lit(float("nan"))).alias(c)
    return made.select("match_id", blank("home"), blank("away"), "status", blank("residual"), "constraints", "weight")
