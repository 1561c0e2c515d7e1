"""Contracts that stop publication, notes by their patterns, tables that are read and written in part."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import contracts as ct, notes as nt
from fieldglass.sources import files


def test_each_rule_counts_its_breaches(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    child = spark.createDataFrame([(1,), (9,), (9,), (None,)], "ref int")
    assert tuple(ct.unique(parent, ["id"], "once").first()) == ("once", 2)
    assert tuple(ct.refers(child, "ref", parent, "id", "known").first()) == ("known", 3)
    assert {r["rule"]: r["n"] for r in ct.holds(child, {"small": F.col("ref") < 5, "there": F.col("ref").isNotNull()}).collect()} == {"small": 3, "there": 1}
    p = spark.createDataFrame([(1, 1.5, 0.7), (1, 2.5, 0.8), (2, 1.5, 0.6), (2, 2.5, 0.4), (3, 1.5, 1.2), (3, 2.5, -0.2), (4, 1.5, None), (4, 2.5, 1.0)], "g int, line double, p double")
    assert ct.adds_up(p, ["g"], "p", "sum").first()["n"] == 3
    assert ct.falls(p, ["g"], "line", "p", "fall").first()["n"] == 1
    none = spark.createDataFrame([], "id int")
    assert ct.unique(none, ["id"], "x").first()["n"] == 0 and ct.refers(none, "id", parent, "id", "x").first()["n"] == 0


def test_a_breach_stops_publication(spark, tmp_path):
    table, path = spark.createDataFrame([(1,), (1,)], "id int"), str(tmp_path / "out")
    with pytest.raises(ct.Breach, match="id once: 1"):
        ct.publish(table, [ct.unique(table, ["id"], "id once"), ct.holds(table, {"fine": F.lit(True)})], path)
    assert not (tmp_path / "out").exists()
    ct.publish(table.distinct(), [ct.unique(table.distinct(), ["id"], "id once")], path)
    assert spark.read.parquet(path).count() == 1


def test_notes(spark):
    day = dt.date(2024, 12, 20)
    rows = [
        ("Left Quadricep injury - Expected back 03 January.", day), ("Wrist injury - 75% chance of playing", day), ("muscular injury - Unknown return date.", day), ("suspended until 1 Nov", day), ("Suspended until 31 Feb.", day),
        ("Has joined Club of Somewhere on loan for the season", day), ("Has joined FC X permanently", day), ("Has returned to Y.", day), ("Has departed the club as a free agent", day), ("Knee injury - Expected back 3 Jan", None),
        ("Knee injury", day), ("", day), (None, day), ("Quad injury - Unknown return date", day), ("A Knee injury - Unknown return date today", day),
    ]
    got = [tuple(r)[2:] for r in nt.parsed(spark.createDataFrame(rows, "news string, added date").coalesce(1)).collect()]
    none = (None,) * 8
    assert got == [
        ("injury_dated", "left quadricep", "muscular", None, dt.date(2025, 1, 3), None, None, None, None), ("injury_chance", "wrist", "ligament", 75, None, None, None, None, None), ("injury_undated", "muscular", "muscular", None, None, None, None, None, None),
        ("suspended_until", None, None, None, None, dt.date(2024, 11, 1), None, None, None), ("suspended_until", None, None, None, None, None, None, None, None), ("loan_out", None, None, None, None, None, "loan", "Club of Somewhere", None),
        ("transfer_out", None, None, None, None, None, "transfer", "FC X", None), ("returned_to", None, None, None, None, None, "transfer", "Y", None), ("free_agent", None, None, None, None, None, "free_agent", None, None), ("injury_dated", "knee", "ligament", None, None, None, None, None, None),
        (*none, "Knee injury"), (None, *none), (None, *none), ("injury_undated", "quad", "unspecified", None, None, None, None, None, None), (*none, "A Knee injury - Unknown return date today"),
    ]


def test_only_the_days_met_are_read(spark, tmp_path):
    path, a, b = str(tmp_path / "log"), dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    make = lambda rows: spark.createDataFrame(rows, "id int, v int, day date")
    files.append_unseen(make([(1, 1, a), (1, 1, a), (2, 1, None)]), path, "id", "day")
    files.append_unseen(make([(1, 2, a), (3, 2, b), (2, 2, None)]), path, "id", "day")
    files.append_unseen(make([(3, 3, b), (4, 3, a)]), path, "id", "day", most_days=1)
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_late_rows_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 3, 1)), (3, None)], "id int, at timestamp")
    with pytest.raises(ValueError, match="2 rows"):
        files.seal(df, str(tmp_path / "seal"), F.col("at"), F.lit("2024-02-01").cast("timestamp"))
    assert not (tmp_path / "seal").exists()
