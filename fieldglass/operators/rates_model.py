"""Minutes, market-implied rates, calibrations and blends as expressions over rows."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldglass.functions.probability import logit, sigmoid

#: Marginal worth of the first to fifth saved transfer. Fixed values.
SAVED = (1.75, 1.35, 1.0, 0.6, 0.3)


def horizon_factor(ahead: Column, rho: float = 0.9, floor: float = 0.4) -> Column:
    """How much of a forecast is left so many rounds ahead."""
    return floor + (1 - floor) * F.pow(F.lit(rho), ahead)


def reversion(ahead: Column, rho: float = 0.8, cap: float = 0.5) -> Column:
    """Weight of the long-run value so many rounds ahead."""
    return cap * (1 - F.pow(F.lit(rho), ahead))


def return_ramp(days: Column, start: float = 0.3, full_days: float = 28) -> Column:
    """Share of the usual minutes so many days after a return (before it: none), rising evenly to all."""
    return F.when(days < 0, 0.0).otherwise(F.least(F.lit(1.0), start + (1 - start) * days / full_days))


def saved_value(free: Column) -> Column:
    """Worth of so many saved transfers: the marginals' sum."""
    return F.aggregate(F.slice(F.array(*map(F.lit, SAVED)), 1, free), F.lit(0.0), lambda a, x: a + x)


def roles(rows: DataFrame, key: str, prior: float = 4) -> DataFrame:
    """Per player the chances to start and finish, start and go off, come on, and not to play: shrunk to the position's, adding up to 1.

    The mean minutes of each case come along; a player is certain by its number of rounds over that and `prior`.
    """
    kind = F.when(F.col("minutes") >= 85, "full").when(F.col("minutes") >= 45, "part").when(F.col("minutes") > 0, "on").otherwise("out")
    marked = rows.withColumn("_kind", kind)
    count = lambda k: F.count_if(F.col("_kind") == k).alias(k)
    own = marked.groupBy(key, "position").agg(*map(count, ("full", "part", "on", "out")), F.count("*").alias("n"))
    base = own.groupBy("position").agg(*[(F.sum(k) / F.sum("n")).alias(f"_{k}") for k in ("full", "part", "on", "out")])
    out = own.join(F.broadcast(base), "position")  # a row a position
    return out.select(key, "position", *[F.round((F.col(k) + prior * F.col(f"_{k}")) / (F.col("n") + prior), 6).alias(f"p_{k}") for k in ("full", "part", "on", "out")], F.round(F.col("n") / (F.col("n") + prior), 6).alias("evidence"))


def level_correction(rows: DataFrame, ours: str, theirs: str, k: float = 20, most: float = 0.2) -> DataFrame:
    """One row: the mean log ratio of the market's rates to ours, shrunk by k rows to none and held within `most`."""
    ratio = F.log(F.col(theirs) / F.col(ours))
    return rows.where((F.col(ours) > 0) & (F.col(theirs) > 0)).agg(F.count("*").alias("n"), F.sum(ratio).alias("_s")).select("n", F.greatest(F.lit(-most), F.least(F.lit(most), F.col("_s") / (F.col("n") + k))).alias("level"))


def anchored(rates: DataFrame, market: DataFrame, level: DataFrame, weight: float = 0.5, cap: float = 0.5, floor: float = 0.9) -> DataFrame:
    """Rates with the market's where it has any: a geometric blend of ours, corrected in level, and theirs, moved by `cap` at most
    in log; a promoted club's rate is at least `floor` of its match's mean. Without a market ours stand."""
    rows = rates.join(market.select("match_id", F.col("home").alias("_mh"), F.col("away").alias("_ma")), "match_id", "left").crossJoin(F.broadcast(level.select("level")))  # one row

    def one(own: str, theirs: str) -> Column:
        base = F.log(F.col(own)) + F.col("level")
        move = F.greatest(F.lit(-cap), F.least(F.lit(cap), weight * (F.log(theirs) - base)))
        return F.when(F.col(theirs).isNotNull(), F.exp(base + move)).otherwise(F.col(own))

    mean = (F.col("home") + F.col("away")) / 2
    blended = rows.withColumn("_h", one("home", "_mh")).withColumn("_a", one("away", "_ma"))
    least = lambda c, flag: F.when(F.col(flag), F.greatest(F.col(c), floor * mean)).otherwise(F.col(c))
    source = F.when(F.col("_mh").isNotNull(), "market").otherwise("model")
    return blended.select("match_id", least("_h", "home_promoted").alias("home"), least("_a", "away_promoted").alias("away"), source.alias("source"))


def preferred(exported: DataFrame, fitted: DataFrame, flat: float, key: str) -> DataFrame:
    """Each fixture's rate from the exported table, else the fitted one, else flat, and where it is from."""
    rows = fitted.withColumnRenamed("rate", "_f").join(exported.withColumnRenamed("rate", "_e"), key, "full")
    return rows.select(key, F.coalesce("_e", "_f", F.lit(flat)).alias("rate"), F.when(F.col("_e").isNotNull(), "exported").when(F.col("_f").isNotNull(), "fitted").otherwise("flat").alias("source"))


def blend(rows: DataFrame, weights: dict[str, float]) -> Column:
    """Weighted mean of the models that have a value, by weights that add up to 1 among them."""
    total = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0))


def platt(rows: DataFrame, p: str = "p", y: str = "y", least: int = 50) -> DataFrame:
    """rows with `calibrated`: a logistic fit of outcomes on log odds; below `least` rows p itself."""
    odds = VectorAssembler(inputCols=["_odds"], outputCol="_x")
    at = odds.transform(rows.withColumn("_odds", logit(F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6)))))
    fitted = at.where(F.col(y).isNotNull())
    if fitted.count() < least:
        return rows.withColumn("calibrated", F.col(p))
    model = LogisticRegression(featuresCol="_x", labelCol=y, tol=1e-12, maxIter=200).fit(fitted)
    return at.withColumn("calibrated", sigmoid(F.lit(model.intercept) + F.lit(model.coefficients[0]) * F.col("_odds"))).drop("_odds", "_x")


def isotonic(rows: DataFrame, p: str = "p", y: str = "y", least: int = 50) -> DataFrame:
    """rows with `calibrated`: the rising step fit of outcomes on p; below `least` rows p itself."""
    fitted = rows.where(F.col(y).isNotNull())
    if fitted.count() < least:
        return rows.withColumn("calibrated", F.col(p))
    model = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="calibrated").fit(fitted)
    return model.transform(rows)


def goal_regression(rows: DataFrame, features: list[str], y: str) -> DataFrame:
    """rows with `rate`: a Poisson regression of goals on features, fitted where y is known."""
    at = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    model = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_x", labelCol=y, predictionCol="rate", regParam=0.01).fit(at.where(F.col(y).isNotNull()))
    return model.transform(at).drop("_x")


def importance(rows: DataFrame, features: list[str], y: str, n: int = 5) -> DataFrame:
    """(feature, weight): the n features of largest correlation with y, in size."""
    wide = rows.agg(*[F.corr(f, y).alias(f) for f in features])
    return wide.unpivot([], features, "feature", "weight").orderBy(F.desc(F.abs("weight")), "feature").limit(n)


def player_events(shares: DataFrame, rates: DataFrame, key: str) -> DataFrame:
    """Per player and match the chance to score: share of the team's expected goals, by the minutes likely to be played."""
    rows = shares.join(rates, key)
    rate = F.col("share") * F.col("rate") * F.col("expected_minutes") / 90
    return rows.withColumn("lambda", rate).withColumn("anytime", 1 - F.exp(-rate))


def counts_fit(rows: DataFrame, team: str, value: str, order: str, recent: int = 10) -> DataFrame:
    """Per row a team's mean over its last `recent` rows against its mean before it, held between 0.6 and 1.5; 1 without five rows."""
    w = W.partitionBy(team).orderBy(order)
    last, ever = F.avg(value).over(w.rowsBetween(-recent, -1)), F.avg(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    n = F.count(value).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("factor", F.when((n >= 5) & (ever > 0), F.greatest(F.lit(0.6), F.least(F.lit(1.5), last / ever))).otherwise(1.0))
