"""Contracts of what is published: keys, references, chances that add up and fall along their lines; a breach stops publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: How far chances may be from adding up. Fixed value.
NEAR = 1e-6


class Breach(ValueError):
    """What stood against publishing."""


def _count(rows: DataFrame, rule: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")


def unique(table: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """(rule, n): keys that stand in several rows; a null in a key is a breach of its own."""
    twice = table.groupBy(*keys).count().where(F.col("count") > 1)
    gaps = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    return _count(twice.select(F.lit(1)).unionByName(table.where(gaps).select(F.lit(1))), rule)


def refers(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """(rule, n): rows of child whose key no row of parent has. The keys are folded before they meet, so a common one is no hot key."""
    used = child.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    known = parent.select(F.col(parent_key).alias("_p")).distinct()
    return used.join(known, F.col("_k") == F.col("_p"), "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).select(F.lit(rule).alias("rule"), "n")


def holds(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule, a null counting as broken; all rules in one pass."""
    wide = table.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()])
    return wide.unpivot([], list(rules), "rule", "n")


def adds_up(chances: DataFrame, group: list[str], p: str, rule: str) -> DataFrame:
    """(rule, n): groups whose chances are no chances or do not add up to one."""
    fine = F.col(p).between(0, 1) & ~F.isnan(p)
    sums = chances.groupBy(*group).agg(F.sum(p).alias("s"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("bad"))
    return _count(sums.where((F.col("bad") > 0) | (F.abs(F.col("s") - 1) > NEAR)), rule)


def falls(chances: DataFrame, group: list[str], line: str, p: str, rule: str) -> DataFrame:
    """(rule, n): places where a chance is greater than that of the line before it."""
    before = F.lag(p).over(W.partitionBy(*group).orderBy(line))
    return _count(chances.withColumn("_before", before).where(F.col(p) > F.col("_before") + NEAR), rule)


def publish(table: DataFrame, checks: list[DataFrame], path: str) -> None:
    """Writes the table as a whole if nothing stands against it; else nothing is written and Breach names every rule with its count."""
    found = reduce(DataFrame.unionByName, checks).where("n > 0").orderBy("rule").collect()  # a row a rule
    if found:
        raise Breach(", ".join(f"{r['rule']}: {r['n']}" for r in found))
    table.write.mode("overwrite").parquet(path)
