"""Simulated matches: draws that depend on keys alone, so any partitioning gives the same results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import markets

#: Matches drawn at once in a task.
BLOCK = 256


def uniform(texts: Iterable[bytes]) -> np.ndarray:
    """A number in [0, 1) of each text: the first 52 bits of its MD5."""
    digests = b"".join([hashlib.md5(t).digest() for t in texts])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)) / float(1 << 52)


def _running(home: np.ndarray, away: np.ndarray, rho: float, top: int) -> np.ndarray:
    """(match, cell): running sums of the chances of each score, by home goals, then away goals; low scores corrected."""
    goals = np.arange(top + 1)
    pmf = lambda r: np.exp(-r)[:, None] * r[:, None] ** goals / np.cumprod(np.maximum(goals, 1.0))
    cells = pmf(home)[:, :, None] * pmf(away)[:, None, :]
    for i, j, factor in ((0, 0, 1 - home * away * rho), (0, 1, 1 + home * rho), (1, 0, 1 + away * rho), (1, 1, 1 - rho)):
        cells[:, i, j] = np.maximum(cells[:, i, j] * factor, 0.0)
    flat = cells.reshape(len(home), -1)
    return np.cumsum(flat / flat.sum(1, keepdims=True), 1)


def _drawn(part: pa.RecordBatch, rho: float, top: int, ends: list[bytes]) -> np.ndarray:
    """(match, draw): the place in the grid of each draw. part: match_id first, both sides' expected goals last; ends: what follows the id in a draw's text."""
    sums = _running(*(part.column(c).to_numpy(zero_copy_only=False) for c in (-2, -1)), rho, top)
    u = uniform(m + end for m in (str(m).encode() for m in part.column(0).to_pylist()) for end in ends).reshape(part.num_rows, len(ends))
    cell = np.zeros(u.shape, np.int32)
    for k in range((top + 1) ** 2 - 1):
        cell += sums[:, k, None] <= u
    return cell


def scores(expected: DataFrame, draws: int, rho: float = -0.05, top: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """(match_id, draw, i, j): `draws` scores of each match by the inverse of its joint distribution; columns `keep` are passed on.

    expected: match_id, home, away (expected goals). The running sums are made once a match and every draw looks its
    place up in them, by the number of the text match:draw:score. Nothing is shuffled: deal the matches out before (spread).
    """
    size, kept = top + 1, ("match_id", *keep)
    rows = expected.select(*kept, F.col("home").cast("double"), F.col("away").cast("double"))
    ends = [f":{d}:score".encode() for d in range(draws)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                cell = _drawn(part, rho, top, ends)
                whose = pa.array(np.repeat(np.arange(n), draws))
                made = np.tile(np.arange(draws, dtype=np.int32), n), cell.ravel() // size, cell.ravel() % size
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(whose) for c in range(len(kept))), *map(pa.array, made)], [*kept, "draw", "i", "j"])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{types}, draw int, i int, j int")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows dealt out by `by` over the session's shuffle partitions, a number that stays: few bytes here are many draws later."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def half_time(drawn: DataFrame, share: float = 0.45) -> DataFrame:
    """Adds half_i, half_j: each goal falls in the first half by a draw of its own, of the text match:draw:side:goal."""
    names, schema = drawn.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in drawn.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [f"{m}:{d}:".encode() for m, d in zip(batch.column("match_id").to_pylist(), batch.column("draw").to_pylist())]
            halves = []
            for goals, side in (("i", b"home:"), ("j", b"away:")):
                n = batch.column(goals).to_numpy(zero_copy_only=False)
                ends = [side + str(g).encode() for g in range(1, int(n.max(initial=0)) + 1)]
                early = uniform(s + end for s, k in zip(starts, n.tolist()) for end in ends[:k]) < share
                halves.append(pa.array(np.bincount(np.repeat(np.arange(len(n)), n), early, len(n)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *halves], [*names, "half_i", "half_j"])

    return drawn.mapInArrow(run, f"{schema}, half_i int, half_j int")


def market_shares(drawn: DataFrame) -> DataFrame:
    """Per match the share of draws in which each market comes in."""
    i, j = F.col("i"), F.col("j")
    events = {"home_win": i > j, "draw_share": i == j, "away_win": i < j, "over_2_5": i + j > 2, "btts": (i > 0) & (j > 0), "home_clean_sheet": j == 0}
    return drawn.groupBy("match_id").agg(F.count("*").alias("draws"), *[F.round(F.avg(e.cast("double")), 6).alias(name) for name, e in events.items()])


def round_points(drawn: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Per team and round: mean, deviation and tails of the points, a round's matches summed on the same draw.

    fixtures: match_id, round, home_id, away_id.
    """
    both = drawn.join(fixtures, "match_id")
    sides = F.explode(F.array(F.struct(F.col("home_id").alias("team"), _points("i", "j").alias("points")), F.struct(F.col("away_id").alias("team"), _points("j", "i").alias("points"))))
    return _by_round(both.select("round", "draw", sides.alias("s")).select("round", "draw", "s.team", "s.points"))


def simulated_rounds(expected: DataFrame, fixtures: DataFrame, draws: int, rho: float = -0.05, top: int = 7) -> DataFrame:
    """What round_points() makes of scores(): the matches of a team's round are brought together before they are drawn.

    No draw is joined or shuffled: a team's matches of a round lie next to each other in one task, which adds up their
    draws and gives one row a team and round. Either side draws the match for itself, with the same scores, as they
    depend on keys alone.
    """
    sides = F.explode(F.array(F.struct(F.col("home_id").alias("team"), F.lit(True).alias("at_home")), F.struct(F.col("away_id").alias("team"), F.lit(False).alias("at_home"))))
    rows = expected.join(fixtures, "match_id").select("match_id", "round", sides.alias("s"), F.col("home").cast("double"), F.col("away").cast("double")).select("match_id", "round", "s.*", "home", "away")
    size, ends = top + 1, [f":{d}:score".encode() for d in range(draws)]
    names = ("round", "team", "matches", "mean", "sd", "p_ge_3", "q90")

    def summed(keys: list[tuple], counts: np.ndarray, points: np.ndarray, kinds: list[pa.DataType]) -> pa.RecordBatch:
        points = np.sort(points, 1)
        at = 0.9 * (draws - 1)
        low, high = points[:, int(np.floor(at))], points[:, int(np.ceil(at))]
        made = counts, points.mean(1), points.std(1), (points >= 3).mean(1), low + (high - low) * (at - np.floor(at))
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], kinds[i]) for i in (0, 1)), *map(pa.array, made)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # key, matches and points of the team and round that may go on
        for part in (batch.slice(at, BLOCK) for batch in batches for at in range(0, batch.num_rows, BLOCK)):
            kinds = [part.column(c).type for c in (1, 2)]
            cell, here = _drawn(part, rho, top, ends), part.column(3).to_numpy(zero_copy_only=False).astype(bool)[:, None]
            i, j = cell // size, cell % size
            mine, other = np.where(here, i, j), np.where(here, j, i)
            keys = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist()))
            starts = [n for n, key in enumerate(keys) if not n or key != keys[n - 1]]
            points = np.add.reduceat(np.where(mine > other, 3, (mine == other).astype(np.int64)), starts, 0)
            counts, keys = np.diff([*starts, len(keys)]).astype(np.int64), [keys[n] for n in starts]
            if last and last[0] == keys[0]:
                counts[0] += last[1]
                points[0] += last[2]
            elif last:
                keys, counts, points = [last[0], *keys], np.append(last[1], counts), np.vstack((last[2], points))
            last = keys[-1], counts[-1], points[-1]
            yield summed(keys[:-1], counts[:-1], points[:-1], kinds)
        if last:
            yield summed([last[0]], np.array([last[1]]), last[2][None, :], kinds)

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("round", "team"))
    out = spread(rows, "round", "team").sortWithinPartitions("round", "team").mapInArrow(run, f"{types}, matches long, mean double, sd double, p_ge_3 double, q90 double")
    return out.select("round", "team", "matches", *[F.round(c, 6).alias(c) for c in names[3:]])


def _points(mine: str, other: str) -> Column:
    return F.when(F.col(mine) > F.col(other), 3).when(F.col(mine) == F.col(other), 1).otherwise(0)


def _by_round(sides: DataFrame) -> DataFrame:
    per = sides.groupBy("round", "team", "draw").agg(F.sum("points").alias("points"), F.count("*").alias("matches"))
    return per.groupBy("round", "team").agg(
        F.max("matches").alias("matches"), F.round(F.avg("points"), 6).alias("mean"), F.round(F.stddev_pop("points"), 6).alias("sd"),
        F.round(F.avg((F.col("points") >= 3).cast("double")), 6).alias("p_ge_3"), F.round(F.percentile("points", F.lit(0.9)), 6).alias("q90"),
    )
