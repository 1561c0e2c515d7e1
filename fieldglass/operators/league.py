"""League tables, head-to-head records, referees and team strengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def count_when(c: Column) -> Column:
    return F.count(F.when(c, 1)).cast("long")


def standings(rows: DataFrame, last: int = 5) -> DataFrame:
    """Per team: played, results, goals, points, the last results oldest first, position. Unplayed rows don't count."""
    done = rows.where("gf is not null and ga is not null")
    result = F.when(F.col("gf") > F.col("ga"), "W").when(F.col("gf") == F.col("ga"), "D").otherwise("L")
    # the form comes from each team's last few rows only, never from a whole season's list
    recent = done.withColumn("rn", F.row_number().over(W.partitionBy("team").orderBy(F.desc("match_date"), F.desc("match_id")))).where(F.col("rn") <= last)
    recent = recent.groupBy("team").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct((-F.col("rn")).alias("o"), result.alias("r")))), lambda x: x["r"])).alias("form"))
    won, drawn = count_when(F.col("gf") > F.col("ga")), count_when(F.col("gf") == F.col("ga"))
    table = done.groupBy("team").agg(F.count("*").alias("played"), won.alias("won"), drawn.alias("drawn"), count_when(F.col("gf") < F.col("ga")).alias("lost"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))
    table = table.withColumn("gd", F.col("gf") - F.col("ga")).withColumn("points", 3 * F.col("won") + F.col("drawn"))
    order = W.orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"), "team")
    return table.join(recent, "team").withColumn("position", F.row_number().over(order).cast("long"))


def referee_profiles(matches: DataFrame, least: int = 3) -> DataFrame:
    """Cards a match of each referee: count, mean, sample deviation, its ratio to the mean, the home side's share above half."""
    cards = F.col("hy") + F.col("ay")
    profile = matches.where("hy is not null").groupBy("referee").agg(F.count("*").alias("n"), F.avg(cards).alias("mean"), F.stddev_samp(cards).alias("sd"), F.sum("hy").alias("home"), F.sum(cards).alias("all"))
    return profile.where(F.col("n") >= least).select("referee", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")), 6).alias("cv"), F.round(F.when(F.col("all") > 0, F.col("home") / F.col("all") - 0.5), 6).alias("home_bias"))


def referee_multiplier(profiles: DataFrame, least: int = 5) -> DataFrame:
    """Each referee's mean against the mean over referees with `least` matches or more."""
    league = profiles.where(F.col("n") >= least).agg(F.avg("mean").alias("league"))
    return profiles.crossJoin(F.broadcast(league)).select("referee", F.round(F.when(F.col("league") > 0, F.col("mean") / F.col("league")).otherwise(1.0), 6).alias("multiplier"))


def home_away_average(rows: DataFrame, value: str) -> DataFrame:
    """Mean of a value over both roles of each team."""
    return rows.groupBy("team").agg(F.round(F.avg(value), 6).alias("average"), F.count(value).alias("n"))


def head_to_head(matches: DataFrame, last: int = 5) -> DataFrame:
    """Per unordered pair of teams: wins of either, draws, ids of the last matches, newest first."""
    low, high = F.least("home_id", "away_id"), F.greatest("home_id", "away_id")
    done = matches.where("fthg is not null").withColumn("a", low).withColumn("b", high)
    winner = F.when(F.col("fthg") > F.col("ftag"), F.col("home_id")).when(F.col("fthg") < F.col("ftag"), F.col("away_id"))
    done = done.withColumn("winner", winner).withColumn("rn", F.row_number().over(W.partitionBy("a", "b").orderBy(F.desc("match_date"), F.desc("match_id"))))
    recent = F.collect_list(F.when(F.col("rn") <= last, F.struct("rn", "match_id")))  # nulls are not collected
    out = done.groupBy("a", "b").agg(count_when(F.col("winner") == F.col("a")).alias("a_wins"), count_when(F.col("winner") == F.col("b")).alias("b_wins"), count_when(F.col("winner").isNull()).alias("draws"), recent.alias("r"))
    return out.withColumn("last", F.concat_ws(",", F.transform(F.sort_array("r"), lambda x: x["match_id"].cast("string")))).drop("r")


def shrunk(total: Column, n: Column, prior: Column, k: float) -> Column:
    """(total + k prior) / (n + k)."""
    return (total + k * prior) / (n + k)


def strengths(matches: DataFrame, k: float = 6.0) -> DataFrame:
    """Attack and defence of each team against the league's mean goals, shrunk by k matches, and the home share of goals."""
    done = matches.where("fthg is not null")
    league = done.agg((F.sum(F.col("fthg") + F.col("ftag")) / (2 * F.count("*"))).alias("m"), (F.sum("fthg") / F.sum(F.col("fthg") + F.col("ftag"))).alias("share"))
    rows = done.select(F.col("home_id").alias("team"), F.col("fthg").alias("gf"), F.col("ftag").alias("ga")).unionByName(done.select(F.col("away_id").alias("team"), F.col("ftag").alias("gf"), F.col("fthg").alias("ga")))
    sums = rows.groupBy("team").agg(F.count("*").alias("n"), F.sum("gf").alias("gf"), F.sum("ga").alias("ga")).crossJoin(F.broadcast(league))
    m = F.col("m")
    return sums.select("team", "n", F.round(shrunk(F.col("gf"), F.col("n"), m, k) / m, 6).alias("attack"), F.round(shrunk(F.col("ga"), F.col("n"), m, k) / m, 6).alias("defence"), F.round(F.coalesce("share", F.lit(0.55)), 6).alias("home_share"))


def availability(players: DataFrame, minutes: int = 90) -> DataFrame:
    """Per team, over players beyond `minutes`: share available, mean form, expected goals."""
    some = players.where(F.col("minutes") > minutes)
    return some.groupBy("team_id").agg(F.round(F.avg(F.col("status").isin("a", "d").cast("double")), 6).alias("available"), F.round(F.avg("xp"), 6).alias("form"), F.sum("goals").alias("goals"))
