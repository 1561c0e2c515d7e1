"""Bounded samples of every bucket, and documents of unknown shape without their private parts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

#: Fields that no published document holds, at any depth. Fixed values.
PRIVATE = ("entry_id", "manager_name", "counterfactuals", "runners_up", "selection_stream")


def bucket_samples(rows: DataFrame, buckets: list[str], row_key: str, value: str, k: int = 256) -> DataFrame:
    """(buckets, n, mean, sample): all values' number and mean, and the values of the k rows of least hashed key, in that order.

    The sample depends on the rows' keys alone, whatever the partitions; keys are unique. Each task keeps k rows a bucket
    before anything is shuffled, and the least k of those are the least k of all, so a bucket of any size costs k rows a task.
    """
    mark = F.md5(F.col(row_key).cast("string").cast("binary"))
    place = F.row_number().over(W.partitionBy(*buckets).orderBy("_mark"))
    kept = rows.select(*buckets, F.col(value).alias("_value"), mark.alias("_mark")).withColumn("_place", place).where(F.col("_place") <= k)
    picked = kept.groupBy(*buckets).agg(F.transform(F.array_sort(F.collect_list(F.struct("_mark", "_value"))), lambda x: x["_value"]).alias("sample"))
    whole = rows.groupBy(*buckets).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    same = [whole[b].eqNullSafe(picked[b]) for b in buckets]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return whole.join(picked, on).select(*[whole[b] for b in buckets], "n", "mean", "sample")


def outcome_buckets(rows: DataFrame) -> DataFrame:
    """rows of players who played, with their bucket: position, goals and assists up to two, a clean sheet or not."""
    two = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(2))
    return rows.where("minutes > 0").withColumns({"goals": two("goals"), "assists": two("assists"), "clean": (F.col("conceded") == 0) & (F.col("minutes") >= 60)})


def canonical(document: Column) -> Column:
    """JSON text with its keys in order and no white space; null for what is no JSON, such as NaN, or repeats a key."""
    return F.to_json(F.try_parse_json(document))


def digest(document: Column, length: int = 16) -> Column:
    """The first digits of the SHA-256 of the canonical text: equal documents collide whatever the order of their keys."""
    return F.substring(F.sha2(canonical(document), 256), 1, length)


def stripped(document: Column, private: tuple[str, ...] = PRIVATE) -> Column:
    """The canonical text without the private fields, at any depth, in objects and in lists; null for what is no JSON."""
    names = frozenset(private)

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if k not in names}
        return [bare(v) for v in x] if isinstance(x, list) else x

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(bare(json.loads(t)), ensure_ascii=False, allow_nan=False), na_action="ignore")

    return canonical(run(canonical(document)))
