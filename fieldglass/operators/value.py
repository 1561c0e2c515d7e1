"""Value bets over every market: edges against the market's own fair chances, thresholds by market, one-sided markets left as quoted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from fieldglass.functions import probability as pr

#: Least edge by market; most of the bank on one bet. Fixed values.
THRESHOLDS = {"1x2": 0.05, "over_under": 0.05, "btts": 0.05, "corners": 0.07, "cards": 0.08, "player_booked": 0.10, "goalscorer": 0.08}
MOST = 0.05


def best_quotes(prices: DataFrame) -> DataFrame:
    """Best price of each outcome (match_id, market, line, outcome) and its book, of equal prices the first; prices of 1 or less are none."""
    keys = ("match_id", "market", "line", "outcome")
    first = F.min_by(F.struct("price", "book"), F.struct(-F.col("price"), "book"))
    return prices.where("price > 1").groupBy(*keys).agg(first.alias("q")).select(*keys, "q.price", "q.book")


def value_bets(chances: DataFrame, quotes: DataFrame, thresholds: dict[str, float] = THRESHOLDS, most: float = MOST) -> DataFrame:
    """match_id, market, line, outcome, book, price, p, implied, edge, stake, half_stake, value, tier of every bet worth making.

    chances: match_id, market, line, outcome, p. quotes: one price of each outcome. implied is the price's chance
    without the margin, where at least two outcomes of the market and line are quoted; of one alone there is no margin to
    take out, and as a share of itself it would be certain, so it stays as quoted. A bet has an edge of its market's
    threshold or more (0.05 for others) and a stake above nothing; stake is a share of the bank, `most` at most; tiers are
    high from 2.5 and medium from 1.5 times the threshold. Null lines are a line of their own.
    """
    keys = W.partitionBy("match_id", "market", "line")
    sided = quotes.where("price > 1").withColumn("_sides", F.count("*").over(keys)).withColumn("_all", F.sum(1 / F.col("price")).over(keys))
    implied = F.when(F.col("_sides") > 1, 1 / F.col("price") / F.col("_all")).otherwise(1 / F.col("price"))
    sided = sided.withColumn("implied", implied)
    c = chances.where("p > 0").select(F.col("match_id").alias("_m"), F.col("market").alias("_k"), F.col("line").alias("_l"), F.col("outcome").alias("_o"), "p")
    rows = sided.join(c, (F.col("match_id") == F.col("_m")) & (F.col("market") == F.col("_k")) & F.col("line").eqNullSafe(F.col("_l")) & (F.col("outcome") == F.col("_o")))
    bar = F.lit(0.05)
    for market, least in thresholds.items():
        bar = F.when(F.col("market") == market, least).otherwise(bar)
    stake = pr.kelly(F.col("p"), F.col("price"), most, least_edge=-1.0)
    rows = rows.withColumn("edge", F.col("p") - F.col("implied")).withColumn("bar", bar).withColumn("stake", stake).where("edge >= bar and stake is not null")
    return rows.select(
        "match_id", "market", "line", "outcome", "book", "price", "p", "implied", "edge", "stake", (F.col("stake") / 2).alias("half_stake"),
        (F.col("p") * (F.col("price") - 1) - (1 - F.col("p"))).alias("value"), pr.tier(F.col("edge"), F.col("bar")).alias("tier"),
    )
