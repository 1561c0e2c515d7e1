"""What the operators share: word patterns, lineage cuts, running sums without one big window, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Words everywhere: runs without ASCII white space. bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of a batch that are worked on, and returned to Spark, together.
PART = 512


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over a task's batches, after which the worker, which waits for its next task, gives back what it no longer needs."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one set on it, or spark.checkpoint.dir. A local session without any gets a temporary folder; a cluster must name one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp("-checkpoint"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there, so that a lost executor costs nothing before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut(), as a Parquet table of its own: what reads it takes only the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, keys: list[str], order: str, ties: list[str], value: str, into: str, per_key: DataFrame | None = None) -> DataFrame:
    """Adds `into`, the sum of `value` over the rows of the same keys that come earlier by (order, ties).

    `keys` hold no nulls; `order` is a lower-case hex digest. Its first three digits cut each key into 4,096 even
    parts: one window runs inside a part, another over the parts' sums, so a key with a third of all rows spreads
    over the cluster. Columns of `per_key` (keys, ...) come along with the parts' sums, without a join by a hot key.
    """
    parted = df.withColumn("_part", F.substring(order, 1, 3))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = parted.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    if per_key is not None:
        sums = sums.join(per_key, keys)
    inside = W.partitionBy(*keys, "_part").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    parted = parted.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return parted.join(sums, [*keys, "_part"]).withColumn(into, F.col("_base") + F.col("_inner")).drop("_part", "_base", "_inner")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in `edges` (a, b): nodes that links join, directly or not, share a root.

    Each round every node hooks onto the neighbour of least hashed name, links are renamed to the hooks and those
    within one hook go. Hashed order leaves no long falling chains, so the links shrink by a factor each round;
    nothing is collected, and each round starts from files in the checkpoint folder.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        hook = cut(hook.select(F.col("a").alias("n"), F.least(rank("a"), "least")["v"].alias("to")))
        # one step up the chain of hooks
        up = hook.select(F.col("n").alias("m"), F.col("to").alias("top"))
        hook = cut(hook.join(up, F.col("to") == F.col("m"), "left").select("n", F.coalesce("top", "to").alias("to")))
        if roots is None:
            roots = hook.select(F.col("n").alias("node"), F.col("to").alias("root"))
        else:
            roots = cut(roots.join(hook, roots["root"] == hook["n"], "left").select("node", F.coalesce("to", "root").alias("root")))
        left, right = hook.select(F.col("n").alias("a"), F.col("to").alias("ta")), hook.select(F.col("n").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(left, "a").join(right, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        edges = cut(moved.where("a <> b").distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def first_rows(docs: DataFrame, kept: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows of docs (doc_id not null) whose (doc_id, xxhash64(text)) is among kept (id, h); of those in `repeated` one each, the first as JSON.

    Columns of docs stay inside a struct, so they may have any name and type.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    at = lambda keys: (F.col("row.doc_id") == keys["id"]) & (F.xxhash64("row.text") == keys["h"])
    named = rows.join(kept, at(kept), "left_semi")
    if not repeated.isEmpty():
        many = named.join(repeated, at(repeated), "left_semi").groupBy(F.col("row.doc_id"), F.xxhash64("row.text")).agg(F.min_by("row", F.to_json("row")).alias("row"))
        named = named.join(repeated, at(repeated), "left_anti").unionByName(many.select("row"))
    return named.select("row.*")
