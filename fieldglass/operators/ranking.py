"""Reader-side projections and rankings as plain expressions: scores of players, glyphs of distributions, cards of bets, ranked news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldglass.functions.folding import folded_once

#: What a fixture of each difficulty, 1 to 5, does to a projection; a position's points to start from, and its cheapest price. Fixed values.
DIFFICULTY = (1.28, 1.14, 1.0, 0.86, 0.72)
BASELINE = {"GKP": 3.35, "DEF": 3.45, "MID": 3.75, "FWD": 3.9}
FLOOR = {"GKP": 4.0, "DEF": 4.0, "MID": 4.5, "FWD": 4.5}
#: Points that a player's glyph spans; hour and minute, UTC, at which prices change. Fixed values.
SCALE, PRICES_CHANGE = (0.0, 18.0), (1, 30)


def _of(values: dict[str, float], by: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(by == k, v).otherwise(out)
    return out


def available(status: Column, chance: Column) -> Column:
    """How likely a player is there: sure if fit, else by the stated chance (a tenth at least), else by the flag."""
    return F.when(status == "a", 1.0).when(chance.isNotNull(), F.greatest(F.lit(0.1), F.least(F.lit(1.0), chance / 100))).when(status == "d", 0.65).otherwise(0.2)


def expected_minutes(minutes: Column, points: Column, there: Column) -> Column:
    """Minutes by what a player's points took, between 45 and 90, 82 without any, times how likely the player is there."""
    usual = F.when(minutes > 0, F.least(F.lit(90.0), F.greatest(F.lit(45.0), minutes / F.greatest(points, F.lit(1)) * 4.5))).otherwise(82.0)
    return F.floor(usual * there + 0.5).cast("int")


def over_fixtures(base: Column, difficulties: Column, horizon: int) -> Column:
    """base over the next `horizon` fixtures by their difficulties; what is not fixed yet counts as even."""
    by = F.array(*map(F.lit, DIFFICULTY))
    known = F.slice(difficulties, 1, horizon)
    return F.aggregate(known, F.lit(0.0), lambda a, d: a + base * F.get(by, d - 1)) + (horizon - F.size(known)) * base


def scored_players(players: DataFrame) -> DataFrame:
    """players with there, expected, base, p4, p6, p10 (points over so many fixtures), captain, value and differential.

    players: position, status, chance, minutes, points, price (in millions), ownership (per cent), form, per_game, official (next
    week's points, 0 if none), difficulties (array of 1 to 5, in order).
    """
    c = F.col
    signal = F.least(F.lit(2.3), F.greatest(F.lit(0.0), c("price") - _of(FLOOR, c("position"))) * 0.19)
    live = F.when((c("form") > 0) | (c("per_game") > 0), c("form") * 0.22 + c("per_game") * 0.18).otherwise(0.0)
    owned = F.least(F.lit(0.35), F.log10(c("ownership") + 1) * 0.18)
    own = _of(BASELINE, c("position")) + c("_signal")
    base = F.when(c("official") > 0, c("official") * 0.58 + (own + live) * 0.42).otherwise(own + owned + live)
    rows = players.withColumn("_signal", signal).withColumn("there", available(c("status"), c("chance")))
    rows = rows.withColumn("base", base).withColumn("expected", expected_minutes(c("minutes"), c("points"), c("there"))).withColumn("_easy", F.size(F.filter(F.slice("difficulties", 1, 6), lambda d: d <= 2)))
    rows = rows.withColumns({f"p{h}": over_fixtures(c("base"), c("difficulties"), h) * c("there") for h in (4, 6, 10)})
    return rows.withColumns({
        "captain": c("p4") * (1 + F.least(F.lit(0.18), c("_signal") * 0.06)) + c("_easy") * 0.45, "value": c("p6") / F.greatest(F.lit(3.5), c("price")),
        "differential": c("p6") * F.greatest(F.lit(0.12), 1 - F.least(F.lit(95.0), c("ownership")) / 100) * (0.85 + c("_easy") * 0.035),
    }).drop("_signal", "_easy")


def glyph(rows: DataFrame, lo: float = SCALE[0], hi: float = SCALE[1]) -> DataFrame:
    """rows (q10, q25, q50, q75, q90, mean, mode) with whisker, box, tail (from, to), median, mean_at, mode_at and blank.

    Places are per cent of the scale, held within it (clamped tells); a span needs both its ends; a scale without width has nothing.
    """
    def place(c: str) -> Column:
        if not hi > lo:
            return F.lit(None).cast("double")
        known = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col(c) - lo) / (hi - lo) * 100)))

    def span(a: str, b: str) -> Column:
        x, y = place(a), place(b)
        return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.least(x, y).alias("from"), F.greatest(x, y).alias("to")))

    made = {"whisker": span("q10", "q90"), "box": span("q25", "q75"), "tail": span("q75", "q90"), "median": place("q50"), "mean_at": place("mean"), "mode_at": place("mode"), "clamped": F.coalesce((F.col("q90") > hi) | (F.col("q10") < lo), F.lit(False))}
    out = rows.withColumns(made)
    return out.withColumn("blank", F.coalesce(F.col("whisker.from"), F.col("box.from"), "median", "mean_at", "mode_at").isNull())


def distributions(rows: DataFrame, by: str, count: str, most: int) -> DataFrame:
    """(by, n, chances): the shares of 0, 1, ... `most` of each group's counts as one array; larger counts are in none."""
    shares = F.array(*[F.count_if(F.col(count) == k) / F.count(count) for k in range(most + 1)])
    return rows.groupBy(by).agg(F.count(count).alias("n"), shares.alias("chances"))


def last_share(rows: DataFrame, by: str, order: list, did: Column, last: int = 5) -> DataFrame:
    """(by, share): in how many of its last `last` rows each key did it."""
    place = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn("_n", place).where(F.col("_n") <= last).groupBy(by).agg(F.avg(did.cast("double")).alias("share"))


def cards(forecasts: DataFrame, odds: DataFrame) -> DataFrame:
    """Forecasts (home, away, day, p) with the odds (home, away, day, book, price) of the same names, case and accents aside: price, books (once
    each, in order), edge, half_stake, matched; best edge first, and by stake those without one last. Forecasts without odds stay."""
    named = folded_once(F.concat_ws("_vs_", "home", "away"))
    # keys are made before they are shuffled, once a row
    found = odds.select(named.alias("_key"), F.col("day").alias("_day"), "price", "book").groupBy("_key", "_day").agg(F.max("price").alias("price"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("price")).alias("less"), "book"))), lambda x: x["book"])).alias("books"))
    rows = forecasts.withColumn("_own", named).join(found, (F.col("_own") == F.col("_key")) & (F.col("day") == F.col("_day")), "left")
    stake = (F.col("p") * F.col("price") - 1) / (F.col("price") - 1) / 2
    rows = rows.withColumn("edge", F.col("p") - 1 / F.col("price")).withColumn("half_stake", F.when((F.col("price") > 1) & (stake > 0), stake)).withColumn("matched", F.col("_key").isNotNull())
    return rows.drop("_own", "_key", "_day").orderBy(F.desc_nulls_last("edge"), F.desc_nulls_last("half_stake"))


def ranked_news(items: DataFrame, touches: Column, at: str, digest: str) -> DataFrame:
    """items with `place`: what touches the squad first, then the newest, then by digest; without a time last of its kind."""
    first = F.row_number().over(W.partitionBy("_touches", F.to_date(at)).orderBy(F.desc_nulls_last(at), digest))
    # days are counted first, so no window holds all items
    rows = items.withColumn("_touches", touches).withColumn("_day", F.to_date(at)).withColumn("_in", first)
    days = rows.groupBy("_touches", "_day").agg(F.count("*").alias("_n"))
    earlier = W.orderBy(F.desc("_touches"), F.desc_nulls_last("_day")).rowsBetween(W.unboundedPreceding, -1)  # a row a day
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    days = days.select(F.col("_touches").alias("_t"), F.col("_day").alias("_d"), before.alias("_before"))
    joined = rows.join(days, F.col("_touches").eqNullSafe(F.col("_t")) & F.col("_day").eqNullSafe(F.col("_d")))
    return joined.withColumn("place", F.col("_before") + F.col("_in")).drop("_touches", "_day", "_in", "_t", "_d", "_before")


def instant(text: Column) -> Column:
    """An ISO time as an instant, UTC where it names no zone; null if it is none."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def prices_changed(captured: Column, now: Column) -> Column:
    """Whether a price change lies between: the first 01:30 UTC after `captured` is not after `now`."""
    hour, minute = PRICES_CHANGE
    boundary = F.date_trunc("day", captured) + F.expr(f"interval {hour} hours {minute} minutes")
    return F.when(boundary > captured, boundary).otherwise(boundary + F.expr("interval 1 day")) <= now


def season_before(label: Column) -> Column:
    """2526 of 2627."""
    start = F.substring(label, 1, 2).cast("int")
    return F.concat(F.lpad(F.pmod(start - 1, F.lit(100)).cast("string"), 2, "0"), F.lpad(start.cast("string"), 2, "0"))
