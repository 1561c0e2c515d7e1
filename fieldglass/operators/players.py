"""Player points, rates, shares, pools and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .league import shrunk
from .quantiles import quantile

#: Points by position. Fixed values of the game's rules.
GOAL = {"GKP": 10, "DEF": 6, "MID": 5, "FWD": 4}
CLEAN_SHEET = {"GKP": 4, "DEF": 4, "MID": 1, "FWD": 0}
QUOTA = {"GKP": 2, "DEF": 5, "MID": 5, "FWD": 3}
#: Legal shares of an eleven: least and most of each position. Fixed values.
BOUNDS = {"GKP": (1, 1), "DEF": (3, 5), "MID": (2, 5), "FWD": (1, 3)}


def by_position(values: dict[str, int], position: Column) -> Column:
    return F.coalesce(*[F.when(position == k, v) for k, v in values.items()], F.lit(0))


def points(rows: DataFrame) -> Column:
    """Points of an appearance. Without minutes only cards count; a red card takes in the yellow."""
    c, back = F.col, F.col("position").isin("GKP", "DEF")
    cards = F.when(c("red") > 0, -3 * c("red")).otherwise(-c("yellow"))
    need = F.when(c("position") == "DEF", 10).when(c("position").isin("MID", "FWD"), 12)
    played = (
        F.when(c("minutes") >= 60, 2).otherwise(1)
        + c("goals") * by_position(GOAL, c("position"))
        + 3 * c("assists")
        + F.when((c("minutes") >= 60) & (c("conceded") == 0), by_position(CLEAN_SHEET, c("position"))).otherwise(0)
        + F.when(back, -F.expr("conceded div 2")).otherwise(0)
        + F.when(c("position") == "GKP", F.expr("saves div 3")).otherwise(0)
        + F.when(c("actions") >= need, 2).otherwise(0)
    )
    return (F.when(c("minutes") > 0, played + cards).otherwise(cards)).cast("long")


def scored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("points", points(rows))


def selling_price(paid: Column, now: Column) -> Column:
    """In tenths: half of a rise is kept, rounded down; a fall counts in full."""
    return F.when(now > paid, paid + F.floor((now - paid) / 2)).otherwise(now).cast("long")


def chance_of_playing(status: Column, chance: Column, stale: Column) -> Column:
    """In order: gone is 0; a stated chance counts; available is 1; old news is 1; doubtful .75; injured or banned .10."""
    return F.when(status.isin("u", "n"), 0.0).when(chance.isNotNull(), chance / 100).when(status == "a", 1.0).when(stale, 1.0).when(status == "d", 0.75).when(status.isin("i", "s"), 0.1).otherwise(0.0)


def recency_rates(rows: DataFrame, value: str, half_life: float = 38.0, prior_minutes: float = 450.0) -> DataFrame:
    """Per player: events for 90 minutes, recent rounds counting more, pulled to the position's rate by `prior_minutes`.

    A row's age is the number of its season before the last times 38 plus rounds before the last.
    """
    seasons = rows.select("season").distinct().withColumn("s", F.dense_rank().over(W.orderBy("season")))
    rows = rows.join(F.broadcast(seasons), "season").withColumn("at", F.col("s") * 38 + F.col("round"))
    last = rows.agg(F.max("at").alias("last"))
    rows = rows.crossJoin(F.broadcast(last)).withColumn("w", F.pow(F.lit(0.5), (F.col("last") - F.col("at")) / half_life))
    sums = rows.groupBy("player_id", "position").agg(F.sum(F.col("w") * F.col("minutes")).alias("m"), F.sum(F.col("w") * F.col(value)).alias("v"))
    prior = sums.groupBy("position").agg((F.sum("v") / F.sum("m")).alias("prior"))
    out = sums.join(F.broadcast(prior), "position")
    return out.select("player_id", "position", F.round(90 * shrunk(F.col("v"), F.col("m"), F.col("prior"), prior_minutes), 6).alias("per_90"), F.round(F.col("m") / (F.col("m") + prior_minutes), 6).alias("evidence"))


def team_shares(rows: DataFrame, value: str, floor: float = 0.01, blend: float = 0.2) -> DataFrame:
    """A player's share of the team's events, blended with an even share, floored and scaled to add up to 1."""
    w = W.partitionBy("team_id")
    total, n = F.sum(value).over(w), F.count("*").over(w)
    raw = rows.withColumn("_raw", F.greatest(F.lit(floor), (1 - blend) * F.coalesce(F.when(total > 0, F.col(value) / total), F.lit(0.0)) + blend / n))
    return raw.select("player_id", "team_id", F.round(F.col("_raw") / F.sum("_raw").over(w), 6).alias("share"))


def bookings(rows: DataFrame, at: float = 0.75) -> DataFrame:
    """Cards for 90 minutes, the chance of one, and whether the rate is in the top quarter of players with minutes."""
    per = rows.groupBy("player_id").agg(F.sum("minutes").alias("m"), F.sum(F.col("yellow") + F.col("red")).alias("cards")).where("m > 0")
    per = per.withColumn("rate", 90 * F.col("cards") / F.col("m"))
    bar = quantile(per, "rate", at, "bar")
    return per.crossJoin(F.broadcast(bar)).select("player_id", F.round("rate", 6).alias("rate"), F.round(F.least(F.lit(0.95), 1 - F.exp(-F.col("rate"))), 6).alias("chance"), (F.col("rate") >= F.col("bar")).alias("magnet"))


def negative_binomial(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Method of moments: n = mean^2 / (variance - mean), p = n / (n + mean); a variance no larger than the mean is raised a little."""
    m = rows.groupBy(key).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    n = F.pow("mean", F.lit(2)) / (F.greatest("var", F.col("mean") * 1.01) - F.col("mean"))
    return m.where("mean > 0").select(key, F.round("mean", 6).alias("mean"), F.round(n, 4).alias("n"), F.round(n / (n + F.col("mean")), 6).alias("p"))


def zero_inflated(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Extra zeros beyond Poisson's, 0 to one half, and the rate of the rest."""
    m = rows.groupBy(key).agg(F.avg(value).alias("mean"), F.avg((F.col(value) == 0).cast("double")).alias("zeros"))
    extra = F.greatest(F.lit(0.0), F.least(F.lit(0.5), F.col("zeros") - F.exp(-F.col("mean"))))
    return m.select(key, F.round(extra, 6).alias("zero_share"), F.round(F.col("mean") / (1 - extra), 6).alias("rate"))


def bonus_buckets(rows: DataFrame) -> DataFrame:
    """Mean and spread of points by position, goals and assists up to 2."""
    cap = lambda c: F.least(F.col(c), F.lit(2)).alias(c)
    return scored(rows).select("position", cap("goals"), cap("assists"), "points").groupBy("position", "goals", "assists").agg(F.count("*").alias("n"), F.round(F.avg("points"), 6).alias("mean"), F.round(F.stddev_pop("points"), 6).alias("sd"))


def ownership(players: DataFrame) -> DataFrame:
    """Share of managers that hold a player: selected over a fifteenth of all selections, 1 at most."""
    whole = players.agg((F.sum("selected_by") / 15).alias("_whole"))
    return players.crossJoin(F.broadcast(whole)).select("player_id", F.round(F.least(F.lit(1.0), F.col("selected_by") / F.col("_whole")), 6).alias("share"))


def universe(players: DataFrame, owned: float = 0.5) -> DataFrame:
    """Available with no stated chance or 50 and more, or owned by enough."""
    return players.where(((F.col("status") == "a") & (F.col("chance").isNull() | (F.col("chance") >= 50))) | (F.col("selected_by") >= owned))


def pool(players: DataFrame, held: DataFrame, minutes: int = 90) -> DataFrame:
    """Each player with the reason it is left out of the pool, null if in. Held players are never left out."""
    p = players.join(held.select("player_id", F.lit(True).alias("held")), "player_id", "left")
    reason = F.when(F.coalesce("held", F.lit(False)), None).when(F.col("status").isin("u", "n"), "gone").when(F.col("minutes") < minutes, "minutes").when(F.col("chance") < 25, "unlikely").when(F.col("xp") <= 0, "no points")
    return p.select("player_id", "team_id", "position", "price", "xp", reason.alias("reason"))


def top_in_group(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def candidates(players: DataFrame, by_value: int = 14, by_points: int = 22) -> DataFrame:
    """Per position the best by expected points together with the best by points for their price."""
    value = players.withColumn("value", F.col("xp") / F.col("price"))
    best = top_in_group(value, ["position"], [F.desc("xp"), "player_id"], by_points)
    cheap = top_in_group(value, ["position"], [F.desc("value"), "player_id"], by_value)
    return best.select("player_id", "position").unionByName(cheap.select("player_id", "position")).distinct()


def best_eleven(squads: DataFrame, key: str) -> DataFrame:
    """Per squad: the legal formation of most points, its points with the captain's doubled, and the captain.

    Players rank inside their position; the sum of the best n of each position gives every formation's points at once.
    """
    ranked = squads.withColumn("n", F.row_number().over(W.partitionBy(key, "position").orderBy(F.desc("xp"), "player_id")))
    within = W.partitionBy(key, "position").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    sums = ranked.withColumn("sum", F.sum("xp").over(within)).where(F.col("n") <= 5)
    best = sums.groupBy(key).agg(*[F.max(F.when((F.col("position") == p) & (F.col("n") == n), F.col("sum"))).alias(f"{p}{n}") for p, (lo, hi) in BOUNDS.items() for n in range(lo, hi + 1)])
    legal = [(d, m, f) for d in range(3, 6) for m in range(2, 6) for f in range(1, 4) if d + m + f == 10]
    options = F.array(*[F.struct((F.col("GKP1") + F.col(f"DEF{d}") + F.col(f"MID{m}") + F.col(f"FWD{f}")).alias("points"), F.lit(f"{d}-{m}-{f}").alias("formation")) for d, m, f in legal])
    top = best.withColumn("o", F.array_max(F.filter(options, lambda o: o["points"].isNotNull())))
    captain = squads.groupBy(key).agg(F.max_by("player_id", F.struct("xp", -F.col("player_id"))).alias("captain"), F.max("xp").alias("extra"))
    return top.where("o is not null").join(captain, key).select(key, F.col("o.formation").alias("formation"), F.round(F.col("o.points") + F.col("extra"), 6).alias("points"), "captain")


def twins(players: DataFrame, near: float = 0.05, apart: float = 1.5) -> DataFrame:
    """Per position: pairs of nearly equal expected points and unlike spread (a, b, gap). A band join on cells of the width `near`."""
    p = players.select("player_id", "position", "xp", "sd", F.floor(F.col("xp") / near).alias("cell"))
    a = p.select("position", F.col("player_id").alias("a"), F.col("xp").alias("xa"), F.col("sd").alias("sa"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    b = p.select("position", F.col("player_id").alias("b"), F.col("xp").alias("xb"), F.col("sd").alias("sb"), "cell")
    j = a.join(b, ["position", "cell"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("xa") - F.col("xb")) <= near) & (F.abs(F.col("sa") - F.col("sb")) >= apart))
    return j.select("position", "a", "b", F.round(F.abs(F.col("sa") - F.col("sb")), 6).alias("gap"))


def best_twins(players: DataFrame, near: float = 0.05, apart: float = 1.5) -> DataFrame:
    """Per position the one pair of nearly equal expected points whose spreads differ most (then the least ids).

    The best pair of two cells is that of one's least and the other's greatest spread within reach, so only the extremes
    of each exact xp are held against each other: at most two rows for each value, not all pairs.
    """
    w = W.partitionBy("position", "xp")
    low, high = F.row_number().over(w.orderBy("sd", "player_id")) == 1, F.row_number().over(w.orderBy(F.desc("sd"), "player_id")) == 1
    ends = players.select("player_id", "position", "xp", "sd", low.alias("_low"), high.alias("_high")).where("_low or _high")
    # one timeline a position: the extremes of spread within `near` behind each row
    back = f"over (partition by position order by cast(xp as double) range between cast({near + 1e-12} as double) preceding and current row)"
    least, most = F.expr(f"min(struct(sd, player_id)) {back}"), F.expr(f"max(struct(sd, -player_id as turned)) {back}")
    met = ends.withColumns({"_least": least, "_most": most})
    pair = lambda other, gap: F.struct(gap.alias("gap"), (-F.least("player_id", other)).alias("a"), (-F.greatest("player_id", other)).alias("b"))
    first = pair(F.col("_least")["player_id"], F.col("sd") - F.col("_least")["sd"])
    second = pair(-F.col("_most")["turned"], F.col("_most")["sd"] - F.col("sd"))
    best = met.groupBy("position").agg(F.max(F.greatest(first, second)).alias("best")).where(F.col("best.gap") >= apart)
    return best.select("position", (-F.col("best.a")).alias("a"), (-F.col("best.b")).alias("b"), F.round("best.gap", 6).alias("gap"))


def transfers(owned: DataFrame, players: DataFrame, bank: int, per_club: int = 3, n: int = 3) -> DataFrame:
    """Per owned player the n best affordable replacements of its position whose club has room, not owned yet."""
    counts = owned.groupBy("team_id").agg(F.count("*").alias("held"))
    free = players.join(owned.select("player_id"), "player_id", "left_anti").join(F.broadcast(counts), "team_id", "left")
    ins = free.select(F.col("player_id").alias("in_id"), "position", F.col("team_id").alias("in_team"), F.col("price").alias("in_price"), F.col("xp").alias("in_xp"), F.coalesce("held", F.lit(0)).alias("held"))
    outs = owned.select(F.col("player_id").alias("out_id"), "position", F.col("team_id").alias("out_team"), (F.col("price") + bank).alias("limit"), F.col("xp").alias("out_xp"))
    # clubs with room take from anyone, so their players are ranked by price and limit alone: an owned player meets a few rows
    cells = _best_by_points(ins.where(F.col("held") < per_club), ["position", "in_price"], n)
    limits = outs.select("position", "limit").distinct()
    best = _best_by_points(cells.join(limits, "position").where(F.col("in_price") <= F.col("limit")), ["position", "limit"], n)
    fields = ["out_id", "out_xp", "in_id", "in_xp"]
    j = outs.join(best.drop("in_team", "in_price", "held"), ["position", "limit"]).select(*fields)
    # a club that holds one too many has room for the player that takes a place of its own
    full = ins.where(F.col("held") == per_club).withColumnRenamed("in_team", "out_team")
    j = j.unionByName(outs.join(full, ["position", "out_team"]).where(F.col("in_price") <= F.col("limit")).select(*fields))
    j = j.where(F.col("in_xp") > F.col("out_xp"))
    j = j.withColumn("gain", F.round(F.col("in_xp") - F.col("out_xp"), 6))
    return top_in_group(j, ["out_id"], [F.desc("gain"), "in_id"], n).select("out_id", "in_id", "gain", F.col("rank").cast("long").alias("rank"))


def _best_by_points(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Of each group the n of most in_xp (equal ones by in_id), and those so close to the last that a rounded gain can be the same."""
    ranked = W.partitionBy(*keys).orderBy(F.desc("in_xp"), "in_id")
    last = F.nth_value("in_xp", n).over(ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    equal = F.row_number().over(W.partitionBy(*keys, "in_xp").orderBy("in_id"))
    kept = rows.withColumn("_last", last).withColumn("_equal", equal).where("_equal <= %d and (_last is null or in_xp >= _last - 2e-6)" % n)
    return kept.drop("_last", "_equal")
