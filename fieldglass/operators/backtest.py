"""Forecasts held against outcomes: composites, folds, walks forward, replays, contracts, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .evaluation import log_loss_of, ranked_score


def evaluate(forecasts: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: count, Brier score over three outcomes, log loss, ranked score, accuracy; forecasts without a result are left out.

    forecasts: match_id, p_h, p_d, p_a. One join and one pass.
    """
    gap = F.col("fthg") - F.col("ftag")
    side = F.when(gap > 0, 0).when(gap == 0, 1).otherwise(2)
    rows = forecasts.join(matches.where("fthg is not null and ftag is not null").select("match_id", side.alias("y")), "match_id")
    p = [F.col("p_h"), F.col("p_d"), F.col("p_a")]
    brier = reduce(lambda a, b: a + b, [F.pow(q - F.when(F.col("y") == k, 1.0).otherwise(0.0), 2) for k, q in enumerate(p)])
    own = F.when(F.col("y") == 0, p[0]).when(F.col("y") == 1, p[1]).otherwise(p[2])
    best = F.when((p[0] >= p[1]) & (p[0] >= p[2]), 0).when(p[1] >= p[2], 1).otherwise(2)
    return rows.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(name) for name, c in (("brier", brier), ("log_loss", -F.log(F.greatest(own, F.lit(1e-15)))), ("rps", ranked_score(p, F.col("y"))), ("accuracy", (best == F.col("y")).cast("double")))])


def band_errors(rows: DataFrame) -> DataFrame:
    """Mean absolute errors of predicted against actual: all, of those who scored nothing, one or two, and who played."""
    off = F.abs(F.col("predicted") - F.col("actual"))
    bands = {"all": F.lit(True), "zero": F.col("actual") == 0, "ones": F.col("actual").isin(1, 2), "played": F.col("minutes") > 0}
    return rows.agg(*[F.round(F.avg(F.when(when, off)), 6).alias(f"mae_{name}") for name, when in bands.items()], *[F.count_if(when).alias(f"n_{name}") for name, when in bands.items()])


def blend_table(rows: DataFrame, a: str, b: str, y: str, fold: str, steps: int = 10) -> DataFrame:
    """(fold, weight, n, loss): summed log loss of weight * a + (1 - weight) * b for every weight in one pass, per fold."""
    losses = [F.sum(log_loss_of(F.lit(w / steps) * F.col(a) + F.lit(1 - w / steps) * F.col(b), F.col(y))).alias(str(w)) for w in range(steps + 1)]
    wide = rows.groupBy(fold).agg(F.count("*").alias("n"), *losses)
    return wide.unpivot([fold, "n"], [str(w) for w in range(steps + 1)], "step", "loss").select(fold, (F.col("step").cast("int") / steps).alias("weight"), "n", "loss")


def best_weights(table: DataFrame, fold: str, flat: float = 1e-3) -> DataFrame:
    """Per fold the weight of least mean loss over the *other* folds, that fold's own mean loss at it, and the lowest and
    highest weight whose loss over the others is within `flat` of the least. Few rows: folds times weights."""
    every = W.partitionBy("weight")
    others = table.withColumn("rest", (F.sum("loss").over(every) - F.col("loss")) / (F.sum("n").over(every) - F.col("n"))).where("rest is not null")
    least = F.min("rest").over(W.partitionBy(fold))
    near = F.when(F.col("rest") <= F.col("least") + flat, F.col("weight"))
    out = others.withColumn("least", least).groupBy(fold).agg(F.min_by("weight", F.struct(F.round("rest", 9), "weight")).alias("weight"), F.min_by(F.col("loss") / F.col("n"), F.struct(F.round("rest", 9), "weight")).alias("loss"), F.min(near).alias("flat_from"), F.max(near).alias("flat_to"))
    return out


def out_of_fold(rows: DataFrame, key: str, fold: str, value: str) -> DataFrame:
    """(key, fold, forecast): the key's mean over all other folds, from one sum a key and fold."""
    sums = rows.groupBy(key, fold).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = W.partitionBy(key)
    n = F.sum("_n").over(w) - F.col("_n")
    return sums.select(key, fold, F.when(n > 0, (F.sum("_s").over(w) - F.col("_s")) / n).alias("forecast"))


def walk_forward(rows: DataFrame, key: str, at: str, value: str, prior: float, k: float = 6) -> DataFrame:
    """(key, at, n, forecast): refitted at each round on the rounds before it: the shrunk mean of what the key did until then."""
    sums = rows.groupBy(key, at).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    before = W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    s, n = F.coalesce(F.sum("_s").over(before), F.lit(0)), F.coalesce(F.sum("_n").over(before), F.lit(0))
    return sums.select(key, at, n.alias("n"), ((s + k * prior) / (n + k)).alias("forecast"))


def replay(rows: DataFrame, recomputed: Column, stored: str) -> DataFrame:
    """Recomputed against stored points: class of the gap, rows, share of all rows. One row a class."""
    gap = recomputed - F.col(stored)
    kind = F.when(F.col(stored).isNull(), "missing").when(gap == 0, "exact").when(F.abs(gap) == 1, "one off").when(gap > 0, "higher").otherwise("lower")
    counts = rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) of the rows that break each rule (condition that must hold; null counts as broken), all in one pass, with 0 for none."""
    wide = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return wide.unpivot([], list(rules), "rule", "n")


def coverage(rows: DataFrame, known: DataFrame, key: str, by: str) -> DataFrame:
    """Per group the share of rows whose key is known."""
    marked = rows.join(known.select(key).distinct().withColumn("_known", F.lit(1)), key, "left")
    return marked.groupBy(by).agg(F.count("*").alias("n"), F.round(F.count("_known") / F.count("*"), 6).alias("share"))


def realised(rows: DataFrame, key: str) -> DataFrame:
    """Points of each player and whether it played at all."""
    return rows.groupBy(key).agg(F.sum("points").alias("points"), (F.max("minutes") >= 1).alias("played"))


def field_calibration(rows: DataFrame, predicted: str, actual: str, mean_band: float, max_band: float) -> DataFrame:
    """Mean and greatest distance of shares from what they turned out to be, and whether both lie within their bands."""
    off = F.abs(F.col(predicted) - F.col(actual))
    out = rows.agg(F.avg(off).alias("mean"), F.max(off).alias("worst"))
    return out.select(F.round("mean", 6).alias("mean"), F.round("worst", 6).alias("worst"), ((F.col("mean") <= mean_band) & (F.col("worst") <= max_band)).alias("calibrated"))


def noise(rows: DataFrame, key: str, value: str, least: int = 30) -> DataFrame:
    """Sample spread of each key and of its mean; null below `least` rows."""
    sd = F.when(F.count(value) >= least, F.stddev_samp(value))
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.round(sd, 6).alias("sd"), F.round(sd / F.sqrt(F.count(value)), 6).alias("se"))


def gates(moves: DataFrame, registry: DataFrame, least_n: int = 10) -> DataFrame:
    """Whether each proposed parameter move may be made: all gates' results and the first one failed, null if none.

    moves: name, now, proposed, n, gain. registry: name, low, high, tier, step.
    """
    rows = moves.join(registry, "name", "left")
    tests = {
        "registered": F.col("tier").isNotNull(), "not_risk": F.coalesce(F.col("tier") != "risk", F.lit(False)), "bounds": F.coalesce(F.col("proposed").between(F.col("low"), F.col("high")), F.lit(False)),
        "step": F.coalesce(F.abs(F.col("proposed") - F.col("now")) <= F.col("step"), F.lit(False)), "enough": F.col("n") >= least_n, "better": F.col("gain") > 0,
    }
    first = F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in tests.items()])
    return rows.select("name", *[ok.alias(name) for name, ok in tests.items()], first.alias("failed"))


def survival(results: DataFrame, move: str, wins: str) -> DataFrame:
    """How often each move wins over perturbed solutions: share and band, most first."""
    out = results.groupBy(move).agg(F.count("*").alias("n"), F.sum(F.col(wins).cast("int")).alias("wins"))
    share = F.col("wins") / F.col("n")
    band = F.when(share >= 0.8, "firm").when(share >= 0.5, "likely").otherwise("fragile")
    return out.select(move, "n", "wins", F.round(share, 6).alias("share"), band.alias("band")).orderBy(F.desc("wins"), move)
