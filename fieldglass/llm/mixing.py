"""Mixing sources to target weights as a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import running_sum, stored, word_count

WEIGHTS = (1, 2, 3)
#: How each source's weight leans over the training run, by turns as the weights: from 1 - lean at the start to 1 + lean at the end.
LEANS = (-0.5, 0.0, 0.5)
REPEATS = 3


def _by_turn(rank: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, leans: tuple = LEANS, repeats: int = REPEATS) -> DataFrame:
    """(key, source, source_size) with each source's target.

    The sum of all sizes is shared by weight. Shares stop at `repeats` times a source's size; what is over goes to
    the others by weight. In order of cap by weight, the sources that stop come first, so one running sum finds the
    level that the others reach. Works on one row a source.
    """
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last(), "key")))
    ranked = ranked.withColumn("weight", _by_turn(F.col("rank"), weights).cast("double")).withColumn("lean", _by_turn(F.col("rank"), leans).cast("double"))
    ranked = ranked.withColumn("cap", (F.lit(repeats) * F.col("source_size")).cast("double"))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = W.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - before) / F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    leveled = ranked.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") > F.col("cap"))
    reached = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    aimed = leveled.withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", reached * F.col("weight"))))
    total = F.sum("target").over(everything)
    tilt = F.when(total > 0, F.sum(F.col("target") * F.col("lean")).over(everything) / total).otherwise(F.lit(0.0))
    return aimed.select("key", "source_size", "target", "lean", tilt.alias("tilt"))


def moment(demand: Column, lean: Column) -> Column:
    """When a source has given the share `demand` of its words: inverse of the integral of 1 + lean (2 t - 1)."""
    b = 1 - lean
    return F.when(demand <= 0, F.lit(0.0)).otherwise(2 * demand / (b + F.sqrt(b * b + 4 * lean * demand)))


def position(demand: Column, lean: Column, tilt: Column) -> Column:
    """The share of all words trained on before: the sources' demands at the moment, summed.

    At time t all sources together have given t + tilt (t^2 - t) of the words, tilt being the mean of the leans by
    target. So equal spans of position hold equal numbers of words, and at each position a source's share of them is
    its weight there over the sum of all weights there.
    """
    t = moment(demand, lean)
    return t + tilt * (t * t - t)


def allot(docs: DataFrame, weights: tuple = WEIGHTS, leans: tuple = LEANS, repeats: int = REPEATS, keep: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: doc (struct of its columns, or of those in `keep`), size, source_size, target, passes, taken, before, lean, position.

    Documents of a source stand in the order of md5(doc_id). A source whose target is r times its size takes every
    document floor(r) times and then the first words in that order up to the rest, so its taken words are its target
    rounded to a word; only the last document of each source is taken in part. position is the share of all words,
    from 0 to 1, after which training first comes to the document; null if nothing of it is taken. A null or empty
    text has size 0; null sources are a source of their own, the last; rows without id stand in the order of their
    text; repeated rows each count, and equal ids by their sizes; an empty table gives an empty result; columns of docs
    keep to the struct, whatever their names. With `keep` the slim rows are written once and read from there.
    """
    rows = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("doc"), "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary")).alias("digest"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    if keep is not None and "text" not in keep:
        rows = stored(rows)
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    rows = running_sum(rows.drop("source"), ["key"], "digest", ["size"], "size", "before", targets(sources, weights, leans, repeats))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("passes", F.floor(ratio)).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    rows = rows.withColumn("part", part).withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
    return rows.withColumn("position", F.when(F.col("taken") > 0, position(F.col("before") / F.col("target"), F.col("lean"), F.col("tilt"))))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, leans: tuple = LEANS, repeats: int = REPEATS) -> DataFrame:
    """The mixed corpus in training order: docs' columns, a row for each time a document is trained on.

    Documents stay whole: the one in which a source's target falls is in if at least half of it is taken. Null and
    empty texts have no words and go; null sources are one source; rows without id stand in the order of their text;
    repeated rows are trained on each; columns of docs keep their names, whatever they are; an empty table gives an
    empty result. Sorting is by ranges of position, so the parts of the output follow the curriculum. Texts are
    shuffled twice: with the running sum of their source, and into ranges. Slim rows would need a join back, which
    is no shuffle less, as rows have no key of their own.
    """
    rows = allot(docs, weights, leans, repeats)
    times = F.col("passes") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    rows = rows.where(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    when = position((F.col("pass") * F.col("source_size") + F.col("before")) / F.col("target"), F.col("lean"), F.col("tilt"))
    rows = rows.withColumn("position", when)
    return rows.repartitionByRange("position", "digest").sortWithinPartitions("position", "digest").select("doc.*")
