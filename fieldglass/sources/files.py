"""Season files and logs as they arrive: CSV of changing columns, JSON lines with bad rows and headers."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", line_breaks: bool = False) -> DataFrame:
    """A CSV with a header, quoted fields, and compression by file ending; all columns are strings.

    With `line_breaks` quoted fields may hold them, and a file is one task; without, large files are split.
    """
    return spark.read.csv(path, header=True, encoding=encoding, quote='"', escape='"', multiLine=line_breaks, ignoreLeadingWhiteSpace=False)


def read_seasons(spark: SparkSession, paths: dict[str, str], strict: bool = False) -> DataFrame:
    """All seasons' rows by column name, with `season_code`; a column that a season lacks is null there.

    A season whose file is not there is left out, or an error if strict.
    """
    found, missing = [], []
    for season, path in sorted(paths.items()):
        try:
            found.append(read_csv(spark, path).withColumn("season_code", F.lit(season)))
        except AnalysisException as gone:
            if gone.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(season)
    if missing and strict or not found:
        raise FileNotFoundError(f"no file for seasons {', '.join(missing)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def read_lines(spark: SparkSession, path: str, schema: str, malformed: str = "fail") -> DataFrame:
    """JSON lines. A malformed line raises (fail), goes (drop), or stays as the text in `_bad` with nulls beside it (keep)."""
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[malformed]
    if malformed == "keep":
        return spark.read.schema(f"{schema}, _bad string").json(path, mode=mode, columnNameOfCorruptRecord="_bad")
    return spark.read.schema(schema).json(path, mode=mode)


def read_sealed(spark: SparkSession, path: str, header: str, rows: str, kind: str = "record") -> tuple[DataFrame, DataFrame]:
    """(header records, row records) of a log that holds both: `kind` is 'header' for the former."""
    lines = spark.read.text(path)
    is_header = F.get_json_object("value", f"$.{kind}") == "header"
    parsed = lambda when, schema: lines.where(F.coalesce(when, F.lit(False))).select(F.from_json("value", schema).alias("r")).select("r.*")
    return parsed(is_header, header), parsed(~F.coalesce(is_header, F.lit(False)), rows)


def quarantine(rows: DataFrame, bad: Column, path: str) -> DataFrame:
    """Writes the bad rows to `path` and returns the others."""
    rows.where(bad).write.mode("append").json(path)
    return rows.where(~F.coalesce(bad, F.lit(False)))


def write_one(df: DataFrame, path: str, kind: str = "json", **options: str) -> None:
    """A small result as one file, replaced as a whole; Spark's commit leaves the old one until the new one is whole."""
    getattr(df.coalesce(1).write.mode("overwrite"), kind)(path, **options)


def append_unseen(new: DataFrame, path: str, key: str, day: str | None = None, most_days: int = 400) -> None:
    """Appends the rows whose key the table at `path` does not hold yet, one for each key; running it again adds nothing.

    With `day`, a column that a key never changes, the table is partitioned by it and only the days that the new rows
    have are read; rows of more than `most_days` days are held against the whole table.
    """
    spark, days = new.sparkSession, []
    if day:
        days = [r[0] for r in new.select(day).distinct().limit(most_days + 1).collect()]
    try:
        known = spark.read.parquet(path)
        if days and len(days) <= most_days:
            known = known.where(F.col(day).isin([d for d in days if d is not None]) | (F.col(day).isNull() if None in days else F.lit(False)))
        new = new.join(known.select(key), key, "left_anti")
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
    writer = new.dropDuplicates([key]).write.mode("append")
    (writer.partitionBy(day) if day else writer).parquet(path)


def seal(rows: DataFrame, path: str, now: Column, deadline: Column) -> None:
    """Writes a forecast once: a row whose deadline has passed, or that has none, is an error, and so is a second seal at the same place."""
    late = rows.where(~F.coalesce(now < deadline, F.lit(False))).count()
    if late:
        raise ValueError(f"{late} rows are past their deadline")
    rows.write.mode("errorifexists").parquet(path)


def keep_last(path_rows: DataFrame, by: str, k: int) -> DataFrame:
    """Rows of the last k values of `by`: what stays after pruning."""
    last = path_rows.select(by).distinct().orderBy(F.desc(by)).limit(k)
    return path_rows.join(F.broadcast(last), by, "left_semi")
