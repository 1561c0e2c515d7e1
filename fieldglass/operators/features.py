"""Features known before a match: every frame ends at the row before, so no result leaks into its own features."""

from __future__ import annotations

from functools import reduce
from math import ceil, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .quantiles import quantile


def team_order(keys: tuple = ("team",)):
    return W.partitionBy(*keys).orderBy("match_date", "match_id")


def ewm_features(rows: DataFrame, values: tuple = ("gf", "shots"), spans: tuple = (3, 5, 10), block: int = 64) -> DataFrame:
    """Exponentially weighted means of the rows before (adjusted weights, gaps keep their place), null until max(1, span // 2) values.

    A team's history is cut into blocks of rows: running sums inside a block, and the sums of the blocks before, each
    weighted down by the block's length. So a row costs the same however long the history, and no power overflows.
    Blocks whose weight is below 1e-16 are left out.
    """
    numbered = rows.withColumn("i", F.row_number().over(team_order()) - 1)
    numbered = numbered.withColumn("b", F.floor(F.col("i") / block)).withColumn("r", F.col("i") % block)
    inside = W.partitionBy("team", "b").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("team").orderBy("b")
    sums, carried, made = [], [], []
    for v in values:
        for s in spans:
            d, name = (s - 1) / (s + 1), f"{v}_{s}"
            up, at = F.pow(F.lit(d), -F.col("r")), F.pow(F.lit(d), F.col("r"))
            parts = {f"{name}_x": F.col(v).cast("double") * up, f"{name}_w": F.when(F.col(v).isNotNull(), up)}
            for k, part in parts.items():
                sums.append((F.sum(part) * d ** (block - 1)).alias(k))
                far = ceil(log(1e-16) / (block * log(d)))
                carried.append(reduce(Column.__add__, [F.coalesce(F.lag(k, n).over(before), F.lit(0.0)) * d ** (block * (n - 1)) for n in range(1, far + 1)]).alias(f"{k}_c"))
            x, w = (F.coalesce(F.sum(part).over(inside), F.lit(0.0)) / d * at + F.col(f"{k}_c") * at for k, part in parts.items())
            enough = F.count(v).over(team_order().rowsBetween(W.unboundedPreceding, -1)) >= max(1, s // 2)
            made.append(F.round(F.when(enough & (w > 0), x / w), 6).alias(f"{v}_ewm{s}"))
    blocks = numbered.groupBy("team", "b").agg(*sums).select("team", "b", *carried)
    return numbered.join(blocks, ["team", "b"]).select("match_id", "team", *made)


def rest_days(rows: DataFrame, default: int = 7, cap: int = 30) -> DataFrame:
    """Days since the team's match before, in either role; unplayed matches count."""
    before = F.lag("match_date").over(team_order())
    return rows.select("match_id", "team", F.coalesce(F.least(F.datediff("match_date", before), F.lit(cap)), F.lit(default)).cast("int").alias("rest"))


def head_to_head_rates(matches: DataFrame) -> DataFrame:
    """Home side's and draws' share of the pair's earlier played matches."""
    pair = matches.withColumn("a", F.least("home_id", "away_id")).withColumn("b", F.greatest("home_id", "away_id"))
    before = W.partitionBy("a", "b").orderBy("match_date", "match_id").rowsBetween(W.unboundedPreceding, -1)
    winner = F.when(F.col("fthg") > F.col("ftag"), F.col("home_id")).when(F.col("fthg") < F.col("ftag"), F.col("away_id")).when(F.col("fthg").isNotNull(), F.lit(-1))
    pair = pair.withColumn("w", winner)
    n = F.count("w").over(before)
    a_wins, b_wins, draws = (F.coalesce(F.sum(F.when(c, 1)).over(before), F.lit(0)) for c in (F.col("w") == F.col("a"), F.col("w") == F.col("b"), F.col("w") == -1))
    per = F.greatest(n, F.lit(1))
    return pair.select("match_id", F.round(F.when(F.col("home_id") == F.col("a"), a_wins).otherwise(b_wins) / per, 6).alias("home_rate"), F.round(draws / per, 6).alias("draw_rate"), n.alias("met"))


def form(rows: DataFrame, last: int = 5) -> DataFrame:
    """Points of the last played matches before this one, over three times their number; 0 without any."""
    points = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).when(F.col("gf").isNotNull(), 0)
    rows = rows.withColumn("points", points)
    # played matches before, as an ordinal: the frame of `last` of them reaches back over gaps
    done = rows.where("points is not null").withColumn("k", F.row_number().over(team_order())).withColumn("sum", F.sum("points").over(team_order().rowsBetween(1 - last, 0))).withColumn("n", F.count("points").over(team_order().rowsBetween(1 - last, 0)))
    k = F.count("points").over(team_order().rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("k", k)
    return rows.join(done.select("team", "k", "sum", "n"), ["team", "k"], "left").select("match_id", "team", F.round(F.coalesce(F.col("sum") / (3 * F.col("n")), F.lit(0.0)), 6).alias("form"))


def conceded(rows: DataFrame, matches: DataFrame, last: int = 10, least: int = 3, default: float = 5.0) -> DataFrame:
    """What each side's opponent lately allowed: mean shots against the opponent in its last matches, on both sides of a match."""
    frame = team_order().rowsBetween(-last, -1)
    own = rows.select("match_id", "team", F.when(F.count("shots_against").over(frame) >= least, F.avg("shots_against").over(frame)).otherwise(default).alias("allowed"))
    home, away = own.select("match_id", F.col("team").alias("home_id"), F.col("allowed").alias("h")), own.select("match_id", F.col("team").alias("away_id"), F.col("allowed").alias("a"))
    joined = matches.join(home, ["match_id", "home_id"]).join(away, ["match_id", "away_id"])
    return joined.select("match_id", F.round("a", 6).alias("home_opponent_conceded"), F.round("h", 6).alias("away_opponent_conceded"))


def derby(matches: DataFrame, pairs: DataFrame) -> DataFrame:
    """1 where the unordered pair of teams is among `pairs` (a, b)."""
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).alias("hit")).distinct()
    m = matches.select("match_id", F.least("home_id", "away_id").alias("a"), F.greatest("home_id", "away_id").alias("b"))
    return m.join(known, ["a", "b"], "left").select("match_id", F.coalesce("hit", F.lit(0)).alias("derby"))


def targets(matches: DataFrame) -> DataFrame:
    result = F.when(F.col("fthg") > F.col("ftag"), 0).when(F.col("fthg") == F.col("ftag"), 1).otherwise(2)
    return matches.where("fthg is not null").select("match_id", (F.col("fthg") + F.col("ftag")).alias("total_goals"), ((F.col("fthg") > 0) & (F.col("ftag") > 0)).cast("int").alias("btts"), result.alias("result"))


def decay(matches: DataFrame, xi: float = 0.003) -> DataFrame:
    """exp(-xi days before the last match)."""
    last = matches.agg(F.max("match_date").alias("last"))
    return matches.crossJoin(F.broadcast(last)).select("match_id", F.round(F.exp(-xi * F.datediff("last", "match_date")), 6).alias("weight"))


def referee_rate(matches: DataFrame, profiles: DataFrame, least: int = 3, default: float = 1.0) -> DataFrame:
    """The referee's card mean on each match if it rests on `least` matches."""
    some = profiles.where(F.col("n") >= least).select("referee", "mean")
    return matches.join(some, "referee", "left").select("match_id", F.round(F.coalesce("mean", F.lit(default)), 6).alias("card_rate"))


def both_sides(matches: DataFrame, teams: DataFrame, columns: list[str]) -> DataFrame:
    """A team table on the home and on the away side."""
    out = matches
    for side in ("home", "away"):
        t = teams.select(F.col("team").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(t, f"{side}_id", "left")
    return out


def elo(matches: DataFrame, k: float = 20.0, home: float = 50.0, start: float = 1500.0, reset: float = 0.33) -> DataFrame:
    """Ratings before each match: match_id, elo_home, elo_away.

    Every rating depends on all earlier matches of the league, so a league is one group: it is bounded by one league's
    fixtures, and leagues (column `league`, if there is one) run side by side.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ratings: dict[int, float] = {}
        season, out = None, []
        for m in frame.sort_values(["match_date", "match_id"]).itertuples():
            if season is not None and m.season != season:
                for t in ratings:
                    ratings[t] = (1 - reset) * ratings[t] + reset * start
            season = m.season
            h, a = ratings.setdefault(m.home_id, start), ratings.setdefault(m.away_id, start)
            out.append((m.match_id, h, a))
            if pd.isna(m.fthg) or pd.isna(m.ftag):
                continue
            gap = m.fthg - m.ftag
            expected = 1 / (1 + 10 ** ((a - (h + home)) / 400))
            move = k * log(max(abs(gap), 1) + 1) * ((1.0 if gap > 0 else 0.5 if gap == 0 else 0.0) - expected)
            ratings[m.home_id], ratings[m.away_id] = h + move, a - move
        return pd.DataFrame(out, columns=["match_id", "elo_home", "elo_away"])

    league = "league" if "league" in matches.columns else None
    rows = matches.withColumn("_league", F.col(league) if league else F.lit(0))
    return rows.groupBy("_league").applyInPandas(run, "match_id long, elo_home double, elo_away double")


def holdout(matches: DataFrame) -> DataFrame:
    """Temporal split: the last season validates."""
    last = matches.agg(F.max("season").alias("last"))
    return matches.crossJoin(F.broadcast(last)).select("match_id", F.when(F.col("season") == F.col("last"), "validate").otherwise("train").alias("part"))


def impute(df: DataFrame, column: str, train: Column) -> DataFrame:
    """Nulls become the training rows' median."""
    middle = quantile(df.where(train), column, 0.5, "_median")
    return df.crossJoin(F.broadcast(middle)).withColumn(column, F.coalesce(F.col(column).cast("double"), "_median")).drop("_median")
