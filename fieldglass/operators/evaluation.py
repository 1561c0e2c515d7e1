"""Scoring rules, calibration and paired comparisons of forecasts (p against y), as aggregates of one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldglass.functions.probability import anytime_radius

from . import markets


def clip(p: Column, eps: float = 1e-15) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def log_loss_of(p: Column, y: Column) -> Column:
    c = clip(p)
    return -(y * F.log(c) + (1 - y) * F.log(1 - c))


def proper_scores(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Brier score, log loss and count, overall or by keys."""
    p, y = F.col("p"), F.col("y")
    return rows.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.round(F.avg(F.pow(p - y, 2)), 6).alias("brier"), F.round(F.avg(log_loss_of(p, y)), 6).alias("log_loss"))


def ranked_score(chances: list[Column], outcome: Column) -> Column:
    """Ranked probability score over ordered outcomes 0 .. n - 1: squared gaps of the cumulative sums over n - 1."""
    total, seen = F.lit(0.0), F.lit(0.0)
    for k, p in enumerate(chances[:-1]):
        seen += p
        total += F.pow(seen - F.when(outcome <= k, 1.0).otherwise(0.0), 2)
    return total / (len(chances) - 1)


def bin_of(p: Column, bins: int = 10) -> Column:
    """Half-open bins; the last is closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Mean forecast and mean outcome of each bin that has rows."""
    return rows.groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("actual"))


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error: the bins' gaps weighted by their rows."""
    per = rows.groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return per.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.max("gap").alias("worst")).select("ece", F.round("worst", 6).alias("worst"))


def errors(rows: DataFrame, groups: list[str], predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """RMSE, mean error and mean absolute error overall and by each of `groups`, in one pass over grouping sets."""
    gap = F.col(predicted) - F.col(actual)
    sets = [[], *[[F.col(g)] for g in groups]]
    aggs = [F.count("*").alias("n"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"), F.round(F.avg(gap), 6).alias("bias"), F.round(F.avg(F.abs(gap)), 6).alias("mae")]
    out = rows.groupingSets(sets, *[F.col(g) for g in groups]).agg(*aggs, F.grouping_id().alias("_g"))
    full, name = (1 << len(groups)) - 1, F.lit("all")
    for i, g in enumerate(groups):
        name = F.when(F.col("_g") == full - (1 << (len(groups) - 1 - i)), g).otherwise(name)
    value = F.coalesce(*[F.col(g).cast("string") for g in groups], F.lit("all"))
    return out.select(name.alias("grouping"), value.alias("value"), "n", "rmse", "bias", "mae")


def coverage(rows: DataFrame, quantiles: list[str], actual: str = "actual") -> DataFrame:
    """Per quantile column: share of outcomes at or below it, and below it."""
    y = F.col(actual)
    long = rows.select(y.alias("y"), F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(q).cast("double").alias("at")) for q in quantiles])).alias("q"))
    hit = lambda c: F.round(F.avg(c.cast("double")), 6)
    return long.groupBy(F.col("q.quantile").alias("quantile")).agg(hit(F.col("y") <= F.col("q.at")).alias("closed"), hit(F.col("y") < F.col("q.at")).alias("open"))


def tail_reliability(rows: DataFrame, points: list[int], predicted: str = "p_ge_", actual: str = "actual") -> DataFrame:
    """Per threshold: mean forecast chance of reaching it, and how often it was."""
    long = rows.select(F.col(actual).alias("y"), F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.col(f"{predicted}{k}").alias("p")) for k in points])).alias("t"))
    return long.groupBy(F.col("t.at").alias("at")).agg(F.round(F.avg("t.p"), 6).alias("predicted"), F.round(F.avg((F.col("y") >= F.col("t.at")).cast("double")), 6).alias("actual"))


def average_ranks(rows: DataFrame, value: str, into: str, keys: list[str]) -> DataFrame:
    """(keys, value, into): rank from 1 of each value in its group, ties at their mean rank, by a running sum over the values' counts."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")
    return counts.select(*keys, value, (before + (F.col("_c") + 1) / 2).alias(into))


def correlations(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Pearson and Spearman correlation by group, of rows with both values; pairs of values and their counts are ranked, not rows."""
    rows = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    plain = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.corr(a, b), 6).alias("pearson"))
    pairs = rows.groupBy(*keys, a, b).agg(F.count("*").alias("_n"))
    for value, into in ((a, "_ra"), (b, "_rb")):
        pairs = pairs.join(average_ranks(rows, value, into, keys), [*keys, value])
    # ranks of a group have the mean (n + 1) / 2
    ranked = pairs.join(plain.select(*keys, ((F.col("n") + 1) / 2).alias("_m")), keys)
    x, y = F.col("_ra") - F.col("_m"), F.col("_rb") - F.col("_m")
    sums = ranked.groupBy(*keys).agg(*[F.sum(F.col("_n") * c).alias(name) for name, c in (("_xy", x * y), ("_xx", x * x), ("_yy", y * y))])
    whole = F.sqrt("_xx") * F.sqrt("_yy")
    return plain.join(sums, keys).select(*keys, "n", "pearson", F.round(F.when(whole > 0, F.col("_xy") / whole), 6).alias("spearman"))


def top_overlap(rows: DataFrame, a: str, b: str, key: str, n: int, groups: list[str]) -> DataFrame:
    """How many of the n highest by `a` are among the n highest by `b`: two limits per group, which cut before the shuffle, and a join of what is left."""
    first = lambda value: rows.withColumn("_k", F.row_number().over(W.partitionBy(*groups).orderBy(F.desc(value), key))).where(F.col("_k") <= n).select(*groups, key)
    shared = first(a).join(first(b).withColumn("_in", F.lit(1)), [*groups, key], "left")
    return shared.groupBy(*groups).agg(F.count("_in").alias("shared"))


def paired(rows: DataFrame, block: str, a: str, b: str) -> DataFrame:
    """Mean of b - a over blocks with its standard error, t and anytime-valid radius; decisive if the interval excludes zero."""
    means = rows.groupBy(block).agg(F.avg(F.col(b) - F.col(a)).alias("d"))
    out = means.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    out = out.withColumn("se", F.col("sd") / F.sqrt("n")).withColumn("radius", anytime_radius(F.col("n"), F.col("sd")))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("n", r("mean"), r("se"), F.round(F.when(F.col("se") > 0, F.col("mean") / F.col("se")), 6).alias("t"), (F.abs("mean") > F.col("radius")).alias("decisive"))


def intraclass(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the spread that lies between groups."""
    total = rows.agg(F.avg(value).alias("m"))
    means = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("g"), F.sum(F.col(value) * F.col(value)).alias("sq"))
    means = means.crossJoin(F.broadcast(total))
    between = F.sum(F.col("n") * F.pow(F.col("g") - F.col("m"), 2))
    whole = F.sum("sq") - F.sum("n") * F.pow(F.first("m"), 2)
    return means.agg(F.round(F.when(whole > 0, between / whole), 6).alias("icc"))


def discrete_crps(scores: DataFrame, actual: DataFrame) -> DataFrame:
    """Per match, over total goals: sum of squared gaps between the forecast's cumulative chances and the outcome's step."""
    totals = scores.groupBy("match_id", (F.col("i") + F.col("j")).alias("k")).agg(F.sum("p").alias("p"))
    cdf = totals.withColumn("c", F.sum("p").over(W.partitionBy("match_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)))
    joined = cdf.join(actual.select("match_id", F.col("total_goals").alias("y")), "match_id")
    return joined.groupBy("match_id").agg(F.round(F.sum(F.pow(F.col("c") - F.when(F.col("y") <= F.col("k"), 1.0).otherwise(0.0), 2)), 6).alias("crps"))


def scoreline_loss(expected: DataFrame, matches: DataFrame, rho: float = -0.05, top: int = 7) -> DataFrame:
    """-ln of the chance of the score that came, scores clipped to the grid's edge. expected: match_id, home, away.

    A match's rates meet its score, and only that score's chance is made: no rows a score are shuffled.
    """
    edge = lambda c: F.least(F.col(c), F.lit(top)).alias(c)
    came = matches.where("fthg is not null").select("match_id", edge("fthg"), edge("ftag"))
    p = markets.score_chance(expected.join(came, "match_id"), F.col("fthg"), F.col("ftag"), rho, top)
    return p.where("p is not null").select("match_id", F.round(-F.log(F.greatest("p", F.lit(1e-15))), 6).alias("loss"))


def blend_search(rows: DataFrame, weights: list[float], block: str) -> DataFrame:
    """Mean log loss of each blend weight w p + (1 - w) q over blocks; the best weight is marked."""
    tried = rows.withColumn("w", F.explode(F.array(*map(F.lit, weights))))
    p = F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("q")
    per = tried.groupBy("w", block).agg(F.avg(log_loss_of(p, F.col("y"))).alias("loss")).groupBy("w").agg(F.avg("loss").alias("loss"))
    best = per.agg(F.min_by("w", F.struct("loss", "w")).alias("best"))
    return per.crossJoin(F.broadcast(best)).select("w", F.round("loss", 6).alias("loss"), (F.col("w") == F.col("best")).alias("best"))


def against_perfect(rows: DataFrame, p: str, variance: Column, y: str) -> DataFrame:
    """One row: n, rmse, bias, and perfect, the root mean square error of a model that knows the truth: what chance alone leaves."""
    off = F.col(p) - F.col(y)
    return rows.agg(F.count("*").alias("n"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(off).alias("bias"), F.sqrt(F.avg(variance)).alias("perfect"))


def likelihoods(chances: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: n, and the mean negative log likelihoods of outcomes and of either side's clean sheets; chances: match_id, home_win, draw,
    away_win, home_clean_sheet, away_clean_sheet. Unplayed matches are left out; a chance is 1e-15 at least."""
    rows = chances.join(matches.where("fthg is not null and ftag is not null").select("match_id", "fthg", "ftag"), "match_id")
    loss = lambda c: -F.log(F.greatest(c, F.lit(1e-15)))
    outcome = F.when(F.col("fthg") > F.col("ftag"), F.col("home_win")).when(F.col("fthg") == F.col("ftag"), F.col("draw")).otherwise(F.col("away_win"))
    sheet = lambda c, goals: F.when(F.col(goals) == 0, F.col(c)).otherwise(1 - F.col(c))
    return rows.agg(F.count("*").alias("n"), F.avg(loss(outcome)).alias("outcome"), F.avg(loss(sheet("home_clean_sheet", "ftag"))).alias("home_sheet"), F.avg(loss(sheet("away_clean_sheet", "fthg"))).alias("away_sheet"))
