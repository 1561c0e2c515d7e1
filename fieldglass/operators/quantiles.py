"""Exact quantiles without all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def quantile(df: DataFrame, column: str, q: float, into: str, near: float = 0.001, accuracy: int = 10_000) -> DataFrame:
    """One row with the exact quantile, interpolated between the two values around (n - 1) q; null without values.

    Approximate quantiles at q - near and q + near, whose ranks are right to 1 / accuracy, enclose it. Rows below are
    counted; of the values between them, with their counts, the running sum finds the rank: only those distinct
    values, about 2 near of them, come into one task.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    marks = rows.agg(F.percentile_approx("_v", [max(0.0, q - near), min(1.0, q + near)], accuracy).alias("_m"), F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    few = F.col("_n") < 10 / near  # ranks that lie too close for the marks
    low = F.col("_lo") if q - near <= 0 else F.when(few, F.col("_lo")).otherwise(F.col("_m")[0])
    high = F.col("_hi") if q + near >= 1 else F.when(few, F.col("_hi")).otherwise(F.col("_m")[1])
    marks = marks.select("_n", low.alias("_from"), high.alias("_to"))
    met = rows.crossJoin(F.broadcast(marks))  # one row
    # rows below are one value, nobody above counts
    value = F.when(F.col("_v") < F.col("_from"), None).otherwise(F.col("_v"))
    counts = met.where("_v <= _to").groupBy(value.alias("_v"), "_n").agg(F.count("*").alias("_c"))
    done = F.sum("_c").over(W.partitionBy("_n").orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0))
    at = (F.col("_n") - 1) * q
    placed = counts.withColumn("_done", done)
    pick = lambda k: F.min(F.when(F.col("_done") > k, F.col("_v")))
    found = placed.agg(pick(F.floor(at)).alias("_a"), F.coalesce(pick(F.ceil(at)), pick(F.floor(at))).alias("_b"), F.max(at - F.floor(at)).alias("_f"))
    return found.select((F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias(into))
