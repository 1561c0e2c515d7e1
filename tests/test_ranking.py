"""Projections and rankings of readers, case by case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldglass.functions.folding import folded
from fieldglass.operators import ranking as rk


def test_availability_and_minutes(spark):
    rows = spark.createDataFrame([("a", 25), ("i", 5), ("i", 130), ("d", None), ("s", None), (None, None)], "status string, chance int").coalesce(1)
    assert [r[0] for r in rows.select(rk.available(F.col("status"), F.col("chance"))).collect()] == [1.0, 0.1, 1.0, 0.65, 0.2, 0.2]
    m = spark.createDataFrame([(0, 0, 1.0), (900, 10, 1.0), (900, 1000, 0.5), (100, 20, 1.0)], "m int, p int, t double").coalesce(1)
    assert [r[0] for r in m.select(rk.expected_minutes(F.col("m"), F.col("p"), F.col("t"))).collect()] == [82, 90, 23, 45]


def test_fixtures_count_by_their_difficulty(spark):
    rows = spark.createDataFrame([([1, 5, 3, 3, 3],), ([2],), ([],)], "d array<int>").coalesce(1)
    got = [r[0] for r in rows.select(rk.over_fixtures(F.lit(2.0), F.col("d"), 4)).collect()]
    assert got == pytest.approx([2 * (1.28 + 0.72 + 1 + 1), 2 * 1.14 + 6, 8])


def test_glyphs(spark):
    rows = [(-1.0, 2.0, 3.0, 6.0, 20.0, 4.5, 2.0), (1.0, None, 3.0, 6.0, 9.0, float("nan"), None), (None, None, None, 6.0, 9.0, None, None)]
    frame = spark.createDataFrame(rows, "q10 double, q25 double, q50 double, q75 double, q90 double, mean double, mode double").coalesce(1)
    one, two, three = rk.glyph(frame).collect()
    assert (one["whisker"]["from"], one["whisker"]["to"], one["clamped"]) == (0, 100, True) and one["mean_at"] == 25 and one["box"]["to"] == pytest.approx(100 / 3)
    assert two["box"] is None and two["mean_at"] is None and not two["clamped"] and not two["blank"] and two["tail"] is not None
    assert three["blank"] and three["tail"] is not None
    assert all(r["blank"] for r in rk.glyph(frame, 5.0, 5.0).collect())


def test_cards_keep_what_has_no_odds(spark):
    day = dt.date(2024, 1, 1)
    f = spark.createDataFrame([(1, "São", "Łódź", day, 0.6), (2, "A", "B", day, 0.5), (3, "sao", "LODZ", day, 0.1)], "id int, home string, away string, day date, p double")
    o = spark.createDataFrame([("SAO", "lodz", day, "x", 2.0), ("sao", "Lodz", day, "y", 3.0), ("sao", "Lodz", day, "x", 2.5), ("sao", "Lodz", dt.date(2024, 1, 2), "z", 9.0)], "home string, away string, day date, book string, price double")
    got = rk.cards(f, o).collect()
    assert [(r["id"], r["matched"], r["price"], r["books"]) for r in got] == [(1, True, 3.0, ["y", "x"]), (3, True, 3.0, ["y", "x"]), (2, False, None, None)]
    assert got[0]["half_stake"] == pytest.approx(0.2) and got[1]["half_stake"] is None


def test_news_are_placed_without_one_window(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(1, at(1, 5), "b", False), (2, at(2, 5), "a", False), (3, None, "c", True), (4, at(1, 5), "a", False), (5, at(1, 9), "z", True), (6, None, "a", False)]
    got = rk.ranked_news(spark.createDataFrame(rows, "id int, at timestamp, digest string, mine boolean").repartition(3), F.col("mine"), "at", "digest").orderBy("place").collect()
    assert [(r["id"], r["place"]) for r in got] == [(5, 1), (3, 2), (2, 3), (4, 4), (1, 5), (6, 6)]


def test_times(spark):
    rows = spark.createDataFrame([("2024-01-01T10:00:00",), ("2024-01-01T10:00:00Z",), ("2024-01-01T12:00:00+02:00",), ("soon",), (None,)], "t string").coalesce(1)
    got = [r[0] for r in rows.select(F.unix_seconds(rk.instant(F.col("t")))).collect()]
    assert got[0] == got[1] == got[2] == 1704103200 and got[3:] == [None, None]
    ts = lambda h, m: F.lit(f"2024-01-01 {h:02d}:{m:02d}:00").cast("timestamp")
    cases = [(ts(1, 0), ts(1, 30), True), (ts(1, 0), ts(1, 29), False), (ts(1, 30), ts(23, 0), False), (ts(2, 0), F.lit("2024-01-02 01:30:00").cast("timestamp"), True)]
    assert [spark.range(1).select(rk.prices_changed(a, b)).first()[0] for a, b, _ in cases] == [c for *_, c in cases]
    labels = spark.createDataFrame([("2627",), ("0001",), ("1011",)], "s string").coalesce(1)
    assert [r[0] for r in labels.select(rk.season_before(F.col("s"))).collect()] == ["2526", "9900", "0910"]


def test_cards_make_a_key_once_a_row(spark):
    """Names of many spellings, equal as the collation has them; each side's keys are made in one place of the plan, before they are shuffled."""
    day = dt.date(2024, 1, 1)
    names = ["Cérclé", "CERCLE", " cercle ", "Straße", "STRASSE", "Æsir", "aesir", "Łódź", "lodz", "ığdır", "IGDIR", "Динамо", "ДИНАМО", "北京", "", "a b", "A b", "Oﬀen", "offen", " x", "x"]
    f = spark.createDataFrame([(n, v, "B", day, 0.5) for n, v in enumerate(names)] + [(99, None, "B", day, 0.5)], "id int, home string, away string, day date, p double")
    o = spark.createDataFrame([(v, "b", day, str(n), 2.0 + n) for n, v in enumerate(names)], "home string, away string, day date, book string, price double")
    pairs = lambda key: {r["id"]: sorted(map(int, r["b"])) for r in f.withColumn("k", key("home", "away")).join(o.withColumn("k2", key("home", "away")), F.expr("k = k2")).groupBy("id").agg(F.collect_list("book").alias("b")).collect()}
    want = pairs(lambda h, a: folded(F.concat_ws("_vs_", h, a)))
    out = rk.cards(f, o)
    assert {r["id"]: sorted(map(int, r["books"])) for r in out.collect() if r["books"]} == want and len(want) == len(names)
    plan = rk.cards(f, o)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "translate" not in plan
