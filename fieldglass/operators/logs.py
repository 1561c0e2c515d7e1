"""Append-only logs: change capture, as-of lookup, claim resolution, diffs, runs, entity linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def digest(*columns: str, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of the columns' canonical JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, length)


def stable_number(text: Column) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the text alone."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def changes(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from the key's row before; the first of a key is a change."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(*order))
    first = F.row_number().over(W.partitionBy(key).orderBy(*order)) == 1
    return log.withColumn("_changed", first | ~F.col(value).eqNullSafe(before)).where("_changed").drop("_changed")


def latest(log: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    return log.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, value: str, least_hours: float = 0.0) -> DataFrame:
    """For each row of left the right side's last value `least_hours` or more before its time.

    Both sides go into one timeline per key and one running window carries the last value along: a single shuffle,
    and no product of a key's rows.
    """
    cut = F.col(at) - F.expr(f"make_dt_interval(0, 0, 0, {least_hours * 3600})")
    marks = left.select(F.col(key).alias("_k"), cut.alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    facts = right.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(None).cast(marks.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    last = F.last("_v", ignorenulls=True).over(W.partitionBy("_k").orderBy("_t", "_side", F.col("_v")).rowsBetween(W.unboundedPreceding, 0))
    return marks.unionByName(facts).withColumn("_last", last).where("_side = 1").select("_row.*", F.col("_last").alias(value))


def within(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, hours: float) -> DataFrame:
    """Pairs of equal keys whose times differ by `hours` at most: an equality join on cells of that length and their neighbours."""
    size = int(hours * 3600)
    cell = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / size)
    near = left.withColumn("_cell", F.explode(F.array(cell(a) - 1, cell(a), cell(a) + 1)))
    gap = F.abs(F.unix_timestamp(F.col(a).cast("timestamp")) - F.unix_timestamp(F.col(b).cast("timestamp")))
    return near.join(right.withColumn("_cell", cell(b)), [*keys, "_cell"]).where(gap <= size).drop("_cell")


def during(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, cell: int = 15) -> DataFrame:
    """Points inside spans of equal keys (both ends included), by cells of `cell` units that a span covers."""
    wide = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    return points.withColumn("_cell", F.floor(F.col(at) / cell)).join(wide, [*keys, "_cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_cell")


def unseen(new: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows of new ids only, one for each."""
    return new.dropDuplicates([key]).join(log.select(key), key, "left_anti")


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer difference of two snapshots: keys with both values where they are not the same, and the kind of change."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    j = a.join(b, keys, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    return j.withColumn("kind", F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").otherwise("changed"))


def material(kind: str, before: Column, after: Column, least: dict[str, float]) -> Column:
    """Whether a change is worth a report: a move of `least[kind]` or more; a first sighting if it is not the ordinary value."""
    return F.when(before.isNull(), after < 100).when(after.isNull(), F.lit(True)).otherwise(F.abs(after - before) >= least[kind])


def resolve(claims: DataFrame, now: Column, stale_days: int = 21, apart: float = 25.0) -> DataFrame:
    """One row for each (player_id, claim_type): value, claim_id, tier, n, conflict, rule.

    claims: claim_id, player_id, claim_type, value (0 .. 100), ts, source, tier (1 best). Only the latest claim of a
    source counts; a stale one loses to any fresh one; the best tier speaks, its most cautious (least) value if its
    sources disagree. A strictly fresher claim of a lower tier may lower that value, never raise it.
    """
    w = W.partitionBy("player_id", "claim_type")
    c = latest(claims, ["player_id", "claim_type", "source"], [F.desc("ts"), F.desc("claim_id")])
    c = c.withColumn("stale", F.col("ts") < now - F.expr(f"interval {stale_days} days"))
    c = c.withColumn("all_stale", F.min(F.col("stale").cast("int")).over(w) == 1).where(~F.col("stale") | F.col("all_stale"))
    c = c.withColumn("top", F.min("tier").over(w))
    best = F.col("tier") == F.col("top")
    c = c.withColumn("top_ts", F.max(F.when(best, F.col("ts"))).over(w)).withColumn("top_value", F.min(F.when(best, F.col("value"))).over(w))
    lower = ~best & (F.col("ts") > F.col("top_ts")) & (F.col("value") < F.col("top_value"))
    out = c.groupBy("player_id", "claim_type").agg(
        F.first("all_stale").alias("stale"), F.first("top").alias("tier"), F.count("*").alias("n"), F.first("top_value").alias("top_value"), F.min(F.when(lower, F.col("value"))).alias("lower"),
        F.max(F.when(best, F.col("value"))).alias("highest"), F.max((~best & (F.col("ts") > F.col("top_ts")) & (F.col("value") > F.col("top_value") + apart)).cast("int")).alias("refused"),
    )
    rule = F.when(F.col("stale"), "stale").when(F.col("lower").isNotNull(), "lowered").when(F.col("highest") - F.col("top_value") >= apart, "cautious").when(F.col("refused") == 1, "refused").otherwise("tier")
    return out.select("player_id", "claim_type", F.coalesce("lower", "top_value").alias("value"), "tier", "n", (F.col("highest") - F.col("top_value") >= apart).alias("conflict"), rule.alias("rule"))


def runs(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """Islands of consecutive rows with the flag: key, start, length."""
    w = W.partitionBy(key).orderBy(*order)
    r = rows.withColumn("_n", F.row_number().over(w)).where(flag)
    r = r.withColumn("_island", F.col("_n") - F.row_number().over(w))
    return r.groupBy(key, "_island").agg(F.min("_n").cast("long").alias("start"), F.count("*").alias("length")).drop("_island")


def sessions(log: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    return log.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def daily_quota(log: DataFrame, key: str, ts: str, cost: str, limit: float) -> DataFrame:
    """Cost used per key and UTC day, and whether it passed the limit."""
    day = log.groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.round(F.sum(cost), 6).alias("used"))
    return day.select(key, F.to_date("w.start").alias("day"), "used", (F.col("used") > limit).alias("over"))


def phase(hours: Column, settled: Column) -> Column:
    """What to do at so many hours before the deadline: settle, locked (30 min), seal (4 h), refresh (48 h), idle."""
    return F.when((hours < 0) & ~settled, "settle").when(hours < 0, "idle").when(hours < 0.5, "locked").when(hours < 4, "seal").when(hours < 48, "refresh").otherwise("idle")


def round_robin(rows: DataFrame, source: str, order: list, cap: int) -> DataFrame:
    """Fills up to `cap` places from the sources in turn, each in its own order."""
    ranked = rows.withColumn("_turn", F.row_number().over(W.partitionBy(source).orderBy(*order)))
    # no place beyond the cap can be reached by a source's later rows
    return ranked.where(F.col("_turn") <= cap).orderBy("_turn", source).limit(cap).drop("_turn")


def strip_html(html: Column) -> Column:
    """Text without tags, with the five common entities, white space collapsed."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def iso_week(season: Column, day: Column) -> Column:
    """season-YYYYWww by ISO weeks."""
    return F.concat(season.cast("string"), F.lit("-"), F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def snowflake_time(number: Column, epoch_ms: int = 1288834974657) -> Column:
    """Milliseconds since 1970 that stand in an id above its low 22 bits."""
    return F.shiftright(number, 22) + epoch_ms


def validated(claims: DataFrame, now: Column, kinds: list[str], least: float = 0, most: float = 100) -> DataFrame:
    """claims with `reason`, why a claim does not count: from the future, value out of range, type unknown; null if it counts."""
    value = F.col("value")
    reason = F.when(F.col("ts") > now, "from the future").when(value.isNull() | ~value.between(least, most), "out of range").when(~F.col("claim_type").isin(kinds), "unknown type")
    return claims.withColumn("reason", reason)


def with_exits(resolved: DataFrame, exits: DataFrame) -> DataFrame:
    """Resolutions in which players who have left for good are 0 whatever else is claimed; `gone` tells which."""
    left = exits.select("player_id", F.lit(True).alias("gone")).distinct()
    gone = F.coalesce("gone", F.lit(False))
    return resolved.join(left, "player_id", "left").withColumn("value", F.when(gone, 0).otherwise(F.col("value"))).withColumn("gone", gone)
