"""Stakes within limits, and falls from the peak."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

#: Shares of the bank at most: of a match, team, market, all, one direction; bets of one match that contain each other, such as
#: over 2.5 and over 1.5 goals, share half a bet's cap.
LIMITS = {"match": 0.15, "team": 0.30, "market": 0.40, "total": 0.20, "direction": 0.10, "nested": 0.025}


def with_teams(bets: DataFrame, matches: DataFrame) -> DataFrame:
    m = matches.select("match_id", "home_id", "away_id", "match_date")
    team = F.when(F.col("outcome") == "H", F.col("home_id")).when(F.col("outcome") == "A", F.col("away_id"))
    goals = F.col("outcome").rlike("^(over|under) ")
    nest = F.when(goals, F.concat_ws(":", F.col("match_id").cast("string"), F.split("outcome", " ")[0]))
    return bets.join(m, "match_id").withColumn("team", team).withColumn("market", F.when(goals, "goals").otherwise("1x2")).withColumn("nest", nest)


def portfolio(bets: DataFrame, limits: dict[str, float] = LIMITS, card: str = "match_date") -> DataFrame:
    """Bets of a card (a day) in order of edge, each clipped to what its match, team, market, direction and the card have left.

    Each stake depends on all before it on its card. Cards are dealt over the cluster and sorted there; a task holds the
    running exposures of one card at a time and no card's rows. Bets that are clipped to nothing go.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, defaultdict(float)
        for frame in frames:
            out = []
            for b in frame.itertuples():
                if b.card != now:
                    now, used = b.card, defaultdict(float)
                keys = [("total",), ("match", b.match_id), ("market", b.market), ("direction", b.outcome)]
                if not pd.isna(b.team):
                    keys.append(("team", int(b.team)))
                if b.nest:
                    keys.append(("nested", b.nest))
                stake = min([b.stake, *[max(0.0, limits[k[0]] - used[k]) for k in keys]])
                if stake > 0:
                    for k in keys:
                        used[k] += stake
                    out.append((b.match_id, b.outcome, b.edge, b.stake, stake))
            yield pd.DataFrame(out, columns=["match_id", "outcome", "edge", "asked", "stake"])

    nest = F.col("nest") if "nest" in bets.columns else F.lit(None).cast("string")
    rows = bets.select(F.col(card).cast("string").alias("card"), "match_id", "market", "outcome", "team", "edge", "stake", nest.alias("nest"))
    rows = rows.repartition("card").sortWithinPartitions("card", F.desc("edge"), "match_id", "outcome")
    return rows.mapInPandas(run, "match_id long, outcome string, edge double, asked double, stake double")


def single_cap(bets: DataFrame, keys: list[str], cap: float) -> DataFrame:
    """One cap only: a clamp of the running sum, with no loop."""
    before = W.partitionBy(*keys).orderBy(F.desc("edge"), "outcome").rowsBetween(W.unboundedPreceding, -1)
    return bets.select(*keys, "outcome", F.least("stake", F.greatest(F.lit(0.0), cap - F.coalesce(F.sum("stake").over(before), F.lit(0.0)))).alias("stake"))


def drawdown(rows: DataFrame, keys: list[str], order: list[str], gain: str = "gain") -> DataFrame:
    """Bank (from 1, compounding), its peak, the fall from it as a share, and what follows: stop at 30 %, half stakes at 20 %."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("bank", F.exp(F.sum(F.log1p(gain)).over(w)))
    out = out.withColumn("peak", F.greatest(F.lit(1.0), F.max("bank").over(w))).withColumn("drawdown", 1 - F.col("bank") / F.col("peak"))
    return out.withColumn("status", F.when(F.col("drawdown") >= 0.3, "stop").when(F.col("drawdown") >= 0.2, "half").otherwise("normal"))
