"""Which of a player's claims a projection uses: all rules in one ranked fold, with the rule that decided and what it beat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: How available each status says a player is. Fixed values.
STATUS = {"a": 1.0, "d": 0.75, "i": 0.1, "s": 0.1, "u": 0.0, "n": 0.0}
#: Claims of one type this far apart are a conflict: points of chance, days of a date. Fixed values.
CHANCE_APART, DAYS_APART = 25, 7
#: Types that say whether a player can play at all; a predicted start is none of them. Fixed values.
AVAILABILITY = ("status", "chance_of_playing", "return_date", "unavailable_until", "permanent_exit")


def invalid() -> Column:
    """Why a claim cannot be used, or null: impossible times, no provenance, a value outside its type's domain."""
    kind, value = F.col("claim_type"), F.col("value")
    inside = lambda top: F.coalesce(F.expr("try_cast(value as double)").between(0, top), F.lit(False))
    return (
        F.when(F.col("observed_at").isNull(), "not observed")
        .when(F.col("claimed_at") > F.col("observed_at"), "claimed after it was observed")
        .when((F.col("tier") >= 2) & (F.coalesce("digest", F.lit("")) == ""), "no provenance")
        .when((kind == "chance_of_playing") & ~inside(100), "out of domain")
        .when((kind == "predicted_start") & ~inside(1), "out of domain")
        .when(kind.isin("return_date", "unavailable_until") & F.expr("try_cast(value as date)").isNull(), "not a date")
        .when((kind == "permanent_exit") & F.coalesce(F.get_json_object(value, "$.kind"), F.lit("")).eqNullSafe(""), "no kind of exit")
    )


def optimism() -> Column:
    """How available a claim says the player is, from 0 to 1; null where it does not say."""
    kind, status = F.col("claim_type"), F.lower(F.trim("value"))
    known = F.lit(None).cast("double")
    for letter, level in STATUS.items():
        known = F.when(status == letter, level).otherwise(known)
    return F.when(kind == "chance_of_playing", F.expr("try_cast(value as double)") / 100).when(kind.isin("permanent_exit", "unavailable_until"), 0.0).when(kind == "status", known)


def _apart(a: Column, b: Column) -> Column:
    """Whether two claims of one type disagree materially."""
    kind = F.col("claim_type")
    day = lambda c: F.to_date(c["value"])
    number = lambda c: c["value"].cast("double")
    fit = lambda c: c["optimism"] > 0.5
    return (
        F.when(kind == "chance_of_playing", F.abs(number(a) - number(b)) >= CHANCE_APART)
        .when(kind.isin("return_date", "unavailable_until"), F.abs(F.datediff(day(a), day(b))) > DAYS_APART)
        .when(kind == "status", a["optimism"].isNull() | b["optimism"].isNull() | (fit(a) != fit(b)))
        .otherwise(a["value"] != b["value"])
    )


def resolve(claims: DataFrame, now: Column, stale_days: int = 21) -> DataFrame:
    """One row for each (player_id, claim_type): value, rule, claim_id, beaten, dropped, unresolved, against.

    claims: claim_id, player_id, claim_type, value (string), claimed_at, observed_at, source, tier (1 best), digest.
    The rules in order: invalid claims are dropped; a stale claim loses to any fresh one; of a source the latest
    counts (by claimed_at, else observed_at, then observed_at, then claim_id); the best tier speaks, its latest claim
    first. Rivals of that tier which disagree materially leave it unresolved, and the least optimistic of them holds.
    A later claim of a lower tier may lower the value, never raise it; the latest that says anything of availability
    decides. A player with a live permanent exit has a chance of 0 whatever else is claimed.

    beaten: valid claims that lost; dropped: invalid ones; against: the claim that a conflict or a refusal was with.
    Types with invalid claims alone have a row without value. Null players are a player of their own; an empty table
    gives an empty result; other columns are not read.

    Claims are folded to one a source where they are read, so the shuffle carries a row for each player, type and
    source; what follows is one more by player, and no player's claims are ever listed.
    """
    at = F.coalesce("claimed_at", "observed_at")
    late = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000) > stale_days
    marked = claims.withColumns({"_good": invalid().isNull(), "_stale": late, "_claim": F.struct(at.alias("at"), "observed_at", "claim_id", "tier", "value", optimism().alias("optimism"))})
    sources = marked.groupBy("player_id", "claim_type", "source").agg(
        F.count_if("_good").alias("valid"), F.count_if(~F.col("_good")).alias("dropped"), F.count_if(F.col("_good") & F.col("_stale")).alias("stale"),
        F.max(F.when(F.col("_good"), F.col("_claim"))).alias("last"), F.max(F.when(F.col("_good") & ~F.col("_stale"), F.col("_claim"))).alias("fresh"),
    )
    sources = sources.repartition("player_id")
    group = W.partitionBy("player_id", "claim_type")
    some_fresh = F.max(F.col("fresh").isNotNull()).over(group)
    sources = sources.withColumn("own", F.when(some_fresh, F.col("fresh")).otherwise(F.col("last")))

    def first(when: Column, *by: Column) -> Column:
        """The greatest claim, as `own`, by `by` among those of the group for which `when` holds."""
        return F.max(F.when(when, F.struct(*[c.alias(f"by{k}") for k, c in enumerate(by)], F.col("own").alias("own"))))

    own, top, challenger = F.col("own"), F.col("top"), F.col("challenger")
    sources = sources.withColumn("top", first(own.isNotNull(), -own["tier"], own).over(group)["own"])
    rival = (own["tier"] == top["tier"]) & (own["claim_id"] != top["claim_id"]) & _apart(top, own)
    below = (own["tier"] > top["tier"]) & (own > top) & own["optimism"].isNotNull() & top["optimism"].isNotNull()
    hope = F.coalesce(own["optimism"], F.lit(1.0))
    folded = sources.groupBy("player_id", "claim_type").agg(
        F.sum("valid").alias("valid"), F.sum("dropped").alias("dropped"), F.sum("stale").alias("stale"), F.count("own").alias("contenders"),
        F.first("top").alias("top"), first(rival, own)["own"].alias("rival"), first(rival | (own["claim_id"] == top["claim_id"]), -hope, own)["own"].alias("cautious"), first(below, own)["own"].alias("challenger"),
    )
    lowers = challenger["optimism"] < top["optimism"]
    rule = (
        F.when(F.col("valid") == 0, "all_claims_invalid").when(F.col("valid") == 1, "only_claim")
        .when(F.col("contenders") == 1, F.when((F.col("stale") > 0) & (F.col("stale") < F.col("valid")), "fresher_claim_beats_stale").otherwise("recency_within_source"))
        .when(F.col("rival").isNotNull(), "unresolved_conservative").when(lowers, "asymmetric_override").when(challenger.isNotNull(), "asymmetric_override_refused").otherwise("tier_precedence")
    )
    folded = folded.withColumn("rule", rule)
    decided = F.col("rule")
    won = F.when(decided == "unresolved_conservative", F.col("cautious")).when(decided == "asymmetric_override", challenger).otherwise(top)
    against = F.when(decided == "unresolved_conservative", F.when(F.col("cautious")["claim_id"] == top["claim_id"], F.col("rival")).otherwise(top)).when(decided == "asymmetric_override", top).when(decided == "asymmetric_override_refused", challenger)
    left = F.max((F.col("claim_type") == "permanent_exit") & won["value"].isNotNull()).over(W.partitionBy("player_id"))
    gone = F.coalesce(left, F.lit(False)) & (F.col("claim_type") == "chance_of_playing")
    return folded.select(
        "player_id", "claim_type", F.when(gone, "0").otherwise(won["value"]).alias("value"), F.when(gone, "permanence_beats_gradation").otherwise(decided).alias("rule"), won["claim_id"].alias("claim_id"),
        F.greatest(F.col("valid") - 1, F.lit(0)).alias("beaten"), "dropped", ((decided == "unresolved_conservative") & ~gone).alias("unresolved"), F.when(~gone, against["claim_id"]).alias("against"),
    )


def fates(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """claims with `fate`: used, beaten, or why it was dropped. No claim goes without one."""
    used = resolved.where("claim_id is not null").select(F.col("claim_id").alias("_used"), F.col("player_id").alias("_player"), F.col("claim_type").alias("_type"))
    own = F.col("claim_id").eqNullSafe(F.col("_used")) & F.col("player_id").eqNullSafe(F.col("_player")) & F.col("claim_type").eqNullSafe(F.col("_type"))
    rows = claims.withColumn("_why", invalid()).join(used, own, "left")
    return rows.select(*claims.columns, F.coalesce("_why", F.when(F.col("_used").isNotNull(), "used").otherwise("beaten")).alias("fate"))


def availability(resolved: DataFrame) -> DataFrame:
    """The resolutions that bear on whether a player can play."""
    return resolved.where(F.col("claim_type").isin(*AVAILABILITY))


def summary(resolved: DataFrame) -> DataFrame:
    """Resolutions, unresolved ones and dropped claims by rule."""
    return resolved.groupBy("rule").agg(F.count("*").alias("n"), F.count_if("unresolved").alias("unresolved"), F.sum("dropped").alias("dropped"), F.count_if((F.col("rule") == "unresolved_conservative") | (F.col("rule") == "asymmetric_override_refused")).alias("escalated"))
