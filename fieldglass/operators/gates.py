"""Whether a fitted parameter may move: all gates on every proposal, with samples counted by what is independent in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Least effective sample for each parameter, parameters of one block, share of the range in one move, level of the interval, rounds before it is finite. Fixed values.
SAMPLE, BLOCK, MOVE, ALPHA, ROUNDS = 500.0, 4, 0.25, 0.01, 10
GATES = ("registered", "not_risk", "tier", "bounds", "move_size", "block_size", "effective_sample", "out_of_sample")


def effective_samples(rows: DataFrame, key: str, block: str, value: str) -> DataFrame:
    """(key, n, blocks, correlation, effective): rows counted by what they tell, given how alike a block's values are.

    correlation is the part of the variance that blocks share (from the sums of squares within and between them, held
    between 0 and 1); effective is n / (1 + (m - 1) correlation), m the blocks' mean size weighted by rows. Two sums
    a block and one pass over the blocks; a block may be of any size. Fewer than two blocks tell nothing apart: effective is 1.
    """
    sums = rows.where(F.col(value).isNotNull()).groupBy(key, block).agg(F.count("*").alias("m"), F.avg(value).alias("mean"), F.var_pop(value).alias("spread"))
    whole = W.partitionBy(key)
    sums = sums.withColumn("centre", F.sum(F.col("m") * F.col("mean")).over(whole) / F.sum("m").over(whole))
    out = sums.groupBy(key).agg(F.sum("m").alias("n"), F.count("*").alias("blocks"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.sum(F.col("m") * F.col("spread")).alias("within"), F.sum(F.col("m") * F.pow(F.col("mean") - F.col("centre"), 2)).alias("between"))
    n, k = F.col("n"), F.col("blocks")
    size = (n - F.col("squares") / n) / (k - 1)
    inside, among = F.when(n > k, F.col("within") / (n - k)).otherwise(0.0), F.col("between") / (k - 1)
    alike = F.when(among + (size - 1) * inside > 0, (among - inside) / (among + (size - 1) * inside)).otherwise(0.0)
    held = F.when(k > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), alike))).otherwise(1.0)
    out = out.withColumn("correlation", held)
    return out.select(key, "n", "blocks", "correlation", (n / (1 + (F.col("squares") / n - 1) * F.col("correlation"))).alias("effective"))


def out_of_sample(differences: DataFrame, key: str, value: str, alpha: float = ALPHA, rho: float = 1.0) -> DataFrame:
    """(key, rounds, mean, lower): the mean gain and the lower end of an interval that holds however often one looks; none below ROUNDS rounds."""
    rows = differences.groupBy(key).agg(F.count(value).alias("rounds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    n, inner = F.col("rounds"), F.col("rounds") * rho**2 + 1
    radius = F.col("sd") * F.sqrt(2 * inner / (n * n * rho**2) * F.log(F.sqrt(inner) / alpha))
    return rows.select(key, "rounds", "mean", F.when(n >= ROUNDS, F.when(F.col("sd") == 0, F.col("mean")).otherwise(F.col("mean") - radius)).alias("lower"))


def promotions(moves: DataFrame, registry: DataFrame, samples: DataFrame, gains: DataFrame) -> DataFrame:
    """name, block, each gate's verdict, failed (all gates that refuse, in order), promoted.

    moves: name, block (parameters proposed together), current, proposed. registry: name, low, high, tier (F and S move, C never,
    risk is not the loop's). samples: name, effective. gains: name, lower. Every gate runs even after one fails; a name in no
    table fails the gates that need it; nothing is clipped.
    """
    rows = moves.join(registry, "name", "left").join(samples.select("name", "effective"), "name", "left").join(gains.select("name", "lower"), "name", "left")
    together = F.count("*").over(W.partitionBy("block"))
    no = lambda c: F.coalesce(c, F.lit(False))
    span = F.col("high") - F.col("low")
    gates: dict[str, Column] = {
        "registered": F.col("tier").isNotNull(), "not_risk": F.coalesce(F.col("tier") != "risk", F.lit(True)) & ~F.startswith("name", F.lit("risk.")), "tier": no(F.col("tier").isin("F", "S")),
        "bounds": no(F.col("proposed").between(F.col("low"), F.col("high"))), "move_size": no((span > 0) & (F.abs(F.col("proposed") - F.col("current")) <= MOVE * span)), "block_size": F.col("_together") <= BLOCK,
        "effective_sample": no(F.col("effective") >= SAMPLE * F.col("_together")), "out_of_sample": no(F.col("lower") > 0),
    }
    rows = rows.withColumn("_together", together).withColumns(gates)
    failed = F.filter(F.array(*[F.when(~F.col(g), g) for g in GATES]), lambda g: g.isNotNull())
    return rows.select("name", "block", *GATES, F.array_join(failed, " ").alias("failed"), (F.size(failed) == 0).alias("promoted"))
