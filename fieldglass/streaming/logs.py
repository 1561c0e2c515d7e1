"""Structured Streaming twins of the log operators: unseen rows, daily sums, sessions, change capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from fieldglass.sources.scratch import scratch
from fieldglass.sources.tables import as_claims


def claims(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The claims of Parquet files at `path` as a stream, `files` of them a batch at most; ts is an instant, as watermarks need."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    # as a pattern: a stream's plain path has to be a folder, and `path` may be one file
    return as_claims(reader.parquet(f"{path[:-1]}[{path[-1]}]")).withColumn("ts", F.col("ts").cast("timestamp"))


def unseen(log: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are forgotten once the watermark has passed them."""
    return log.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily(log: DataFrame, key: str, ts: str, cost: str, delay: str = "2 hours") -> DataFrame:
    """Cost per key and UTC day, once the day is closed: the watermark has reached its end."""
    day = log.withWatermark(ts, delay).groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.sum(cost).alias("used"))
    return day.select(key, F.to_date("w.start").alias("day"), "used")


def sessions(log: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Closed sessions: key, start, n. Rows of a key less than `gap` apart are of one session."""
    return log.withWatermark(ts, delay).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def replay(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append-mode stream over all that its source holds now, in a new checkpoint, and gives its output table."""
    folder = scratch(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True)
    writer.start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def changes(stream: DataFrame, key: str, value: str, order: list[str], folder: str) -> DataFrame:
    """Appends to `folder` the rows whose value is not that of their key's row before; gives the table so far.

    Batches count in the order of their arrival, rows of a batch by `order`. Each batch is one window over its rows
    and one row a known key. Both of its outputs are named by the batch's number and written over, so a batch that runs
    again after a loss leaves the same files; the keys' last values stand in two folders by turns.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("_new", F.lit(True))
        if epoch:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{folder}/last/{(epoch - 1) % 2}").withColumn("_new", F.lit(False)))
        w = W.partitionBy(key).orderBy("_new", *order)
        changed = rows.withColumn("_first", F.row_number().over(w) == 1).withColumn("_before", F.lag(value).over(w))
        changed = changed.where(F.col("_new") & (F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))))
        changed.select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/changes/batch={epoch}")
        last = rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct("_new", *order)).alias("row"))
        last.select("row.*").write.mode("overwrite").parquet(f"{folder}/last/{epoch % 2}")

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/changes").select(*stream.columns)
