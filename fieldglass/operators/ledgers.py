"""Ledgers of forecasts and outcomes, windows of news, streaks, versions and the like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def player_stats(elements: DataFrame, clubs: DataFrame) -> DataFrame:
    """Elements of the feed with club names, rates for 90 minutes (null without minutes) and availability; gone players left out."""
    rows = elements.where("status <> 'u'").join(clubs, "team_id", "left")
    rate = F.when(F.col("minutes") > 0, F.round(F.col("goals") * 90 / F.col("minutes"), 6))
    return rows.select("player_id", "club", "position", rate.alias("goals_per_90"), F.col("status").isin("a", "d").alias("available"))


def last_before(forecasts: DataFrame, starts: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """Of each key the last forecast made strictly before its start; later ones are refused."""
    rows = forecasts.join(starts.select(key, start), key).where(F.col(at) < F.col(start))
    return rows.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value), F.max(at).alias(at))


def next_after(rows: DataFrame, marks: DataFrame, key: str, at: str, mark: str, into: str) -> DataFrame:
    """rows with the first `mark` of their key at or after `at`: one timeline a key, no product."""
    left = rows.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.struct(*rows.columns).alias("_row"), F.lit(0).alias("_side"))
    right = marks.select(F.col(key).alias("_k"), F.col(mark).alias("_t"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.lit(1).alias("_side"))
    ahead = F.first(F.when(F.col("_side") == 1, F.col("_t")), ignorenulls=True).over(W.partitionBy("_k").orderBy("_t", "_side").rowsBetween(0, W.unboundedFollowing))
    return left.unionByName(right).withColumn("_ahead", ahead).where("_side = 0").select("_row.*", F.col("_ahead").alias(into))


def in_window(news: DataFrame, starts: DataFrame, key: str, at: str, start: str, opens: float = 72, closes: float = 2) -> DataFrame:
    """News between `opens` and `closes` hours before the next start of its key that is still that far away."""
    shifted = news.withColumn("_from", F.col(at) + F.expr(f"make_dt_interval(0, 0, 0, {closes * 3600})"))
    found = next_after(shifted, starts, key, "_from", start, "_start")
    return found.where(F.col("_start") <= F.col(at) + F.expr(f"make_dt_interval(0, 0, 0, {opens * 3600})")).drop("_from", "_start")


def streaks(log: DataFrame, key: str, order: list[str], failed: Column, limit: int = 3) -> DataFrame:
    """log with `streak`, the failures in a row up to each row, and `status`: escalate from `limit` of them on."""
    w = W.partitionBy(key).orderBy(*order)
    rows = log.withColumn("_failed", failed).withColumn("_n", F.row_number().over(w))
    good = F.coalesce(F.max(F.when(~F.col("_failed"), F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("streak", F.when(F.col("_failed"), F.col("_n") - good).otherwise(0).cast("long")).drop("_failed", "_n")
    return rows.withColumn("status", F.when(F.col("streak") >= limit, "escalate").when(F.col("streak") > 0, "failing").otherwise("fine"))


def settled(rows: DataFrame, keys: list[str], final: str, at: str, value: str) -> DataFrame:
    """One row a key: a final value before any provisional one, then the latest."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(final, at, value)).alias(value), F.max(final).alias(final))


def merged(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """Both feeds with one row a key, the newest; the new feed's where both are as new."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc(at), F.desc("_new")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "_new")


def rolled_back(versions: DataFrame, name: str, to: DataFrame) -> DataFrame:
    """versions (name, version, value) with a new version of each name in `to` (name, version): the value it had then. History only grows."""
    last = versions.groupBy(name).agg(F.max("version").alias("_last"))
    back = versions.join(to, [name, "version"]).join(last, name).select(name, (F.col("_last") + 1).alias("version"), "value")
    return versions.select(name, "version", "value").unionByName(back)


def current(versions: DataFrame, name: str) -> DataFrame:
    """The value of each name's last version."""
    return versions.groupBy(name).agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value"))


def prices_paid(moves: DataFrame, key: str, order: list[str], bought: Column, price: str) -> DataFrame:
    """Sales with the price of the key's last purchase before them; null if there was none."""
    before = F.last(F.when(bought, F.col(price)), ignorenulls=True).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return moves.withColumn("paid", before).where(~bought)


def fullest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Of rows that repeat their keys the one of greatest `by`."""
    order = F.struct(*by)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")


def by_digest(items: DataFrame, content: list[Column], player: str, at: str) -> DataFrame:
    """Items of equal content as one: digest, number of players, first of them, when first seen."""
    digest = F.md5(F.concat_ws("|", *content))
    return items.groupBy(digest.alias("digest")).agg(F.count_distinct(player).alias("n_players"), F.min(player).alias("first_player"), F.min(at).alias("first_seen"))


def current_round(rounds: DataFrame) -> DataFrame:
    """The round marked current; else the first that is not finished; else the last."""
    return rounds.agg(F.coalesce(F.min(F.when(F.col("is_current"), F.col("round"))), F.min(F.when(~F.col("finished"), F.col("round"))), F.max("round")).alias("round"))


def upcoming(fixtures: DataFrame, rounds: DataFrame, now: Column) -> DataFrame:
    """Fixtures of the current round that are unplayed and start after now; if it has none, those of the next round."""
    at = current_round(rounds).withColumnRenamed("round", "_round")
    rows = fixtures.where(~F.col("finished")).crossJoin(F.broadcast(at))
    ahead = rows.where((F.col("round") == F.col("_round") + 1) | ((F.col("round") == F.col("_round")) & (F.col("start") > now)))
    first = ahead.agg(F.min("round").alias("_first"))
    return ahead.crossJoin(F.broadcast(first)).where("round = _first").drop("_round", "_first")


def recent(rows: DataFrame, at: str, since: Column) -> DataFrame:
    """Rows since a time; those without a time stay."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= since))


def reported(changes: DataFrame, line: float = 50) -> DataFrame:
    """Changes (before, after, reported) with `flip`, whether the value crosses the line between playing and not; flips are always reported."""
    side = lambda c: F.coalesce(F.col(c), F.lit(100)) >= line
    rows = changes.withColumn("flip", side("before") != side("after"))
    return rows.withColumn("reported", F.col("flip") | F.col("reported"))


def carried(weeks: DataFrame, key: str, order: str, used: str, most: int = 5) -> DataFrame:
    """Free transfers before each week: min(most, max(0, free - used) + 1) from 1 on.

    A clamp of a clamp is folded over the weeks of a key in order, one season's weeks at most.
    """
    weeks_ = F.sort_array(F.collect_list(F.struct(order, used)))
    step = lambda free, n: F.least(F.lit(most), F.greatest(F.lit(0), free - n) + 1)
    start = F.array(F.struct(F.lit(None).cast("int").alias("w"), F.lit(1).alias("free")))

    def fold(done: Column, row: Column) -> Column:
        free = F.element_at(done, -1)["free"]
        shown = F.struct(row[order].cast("int").alias("w"), free.alias("free"))
        return F.concat(F.slice(done, 1, F.size(done) - 1), F.array(shown, F.struct(F.lit(None).cast("int").alias("w"), step(free, row[used].cast("int")).alias("free"))))

    rows = weeks.groupBy(key).agg(weeks_.alias("_weeks")).select(key, F.explode(F.aggregate("_weeks", start, fold)).alias("_r"))
    return rows.where("_r.w is not null").select(key, F.col("_r.w").alias(order), F.col("_r.free").alias("free"))
