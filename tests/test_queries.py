"""Every registered query of the library against its SQL, and small cases made by hand."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldglass.functions import probability as pr
from fieldglass.operators import features, logs, players, risk
from fieldglass.plans.all_queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, (bool, int, float)) or hasattr(v, "is_finite"):
        return (1, "nan" if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}"))
    return (2, str(v).removesuffix(" 00:00:00"))


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    rows, cols = df.collect(), sorted(df.columns)
    assert rows, "a query without rows shows nothing"
    if name not in ORACLES:
        return
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    expected = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == expected


def test_moving_average_of_a_long_history_with_gaps(spark):
    import pandas as pd

    x = [None if i % 7 == 3 or 200 < i < 205 else float(i * 37 % 11) for i in range(1500)]
    df = spark.createDataFrame([(i, dt.date(2000, 1, 1) + dt.timedelta(i), 1, v) for i, v in enumerate(x)], "match_id long, match_date date, team int, gf double")
    got = features.ewm_features(df, ("gf",), (3, 10)).orderBy("match_id").toPandas()
    for span in (3, 10):
        want = pd.Series(x, dtype=float).ewm(span=span, min_periods=max(1, span // 2)).mean().shift(1)
        assert got[f"gf_ewm{span}"].isna().tolist() == want.isna().tolist()
        assert (got[f"gf_ewm{span}"] - want).abs().max() < 1e-5


@pytest.mark.parametrize("method", ["proportional", "power", "shin"])
def test_fair_probabilities_add_up(spark, method):
    df = spark.createDataFrame([([0.5, 0.3, 0.27],), ([0.6, 0.45],), (None,)], "q array<double>")
    got = [r[0] for r in df.select(pr.devig(F.col("q"), method)).collect()]
    assert got[2] is None and all(sum(p) == pytest.approx(1) for p in got[:2])


@pytest.mark.parametrize("parts", [1, 7])
def test_portfolio_caps(spark, parts):
    rows = [(1, "1x2", "H", 5, 0.3 - k / 100, 0.05, "d") for k in range(6)] + [(2, "1x2", "D", None, 0.01, 0.05, "d"), (3, "1x2", "D", None, 0.01, 0.05, "e")]
    bets = spark.createDataFrame(rows, "match_id long, market string, outcome string, team int, edge double, stake double, match_date string").repartition(parts)
    got = risk.portfolio(bets).collect()
    direction = sum(r["stake"] for r in got if r["match_id"] == 1)
    assert direction == pytest.approx(0.10) and len(got) == 4


def test_points_rules(spark):
    cols = "position string, minutes int, goals int, assists int, conceded int, saves int, yellow int, red int, actions int"
    rows = [("DEF", 90, 1, 0, 0, 0, 0, 0, 10), ("GKP", 90, 0, 0, 3, 7, 0, 0, 50), ("MID", 0, 1, 1, 0, 0, 1, 0, 20), ("FWD", 59, 1, 0, 0, 0, 1, 1, 12)]
    assert [r[0] for r in spark.createDataFrame(rows, cols).coalesce(1).select(players.points(None)).collect()] == [14, 3, -1, 4]


def test_material_and_resolution(spark):
    cols = "claim_id long, player_id int, claim_type string, value int, ts timestamp, source string, tier int"
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, 1, "c", 75, day(5), "a", 1), (2, 1, "c", 25, day(6), "b", 2), (3, 2, "c", 25, day(5), "a", 1), (4, 2, "c", 100, day(6), "b", 2), (5, 3, "c", 100, day(5), "a", 1), (6, 3, "c", 0, day(5), "b", 1)]
    got = {r["player_id"]: (r["value"], r["rule"]) for r in logs.resolve(spark.createDataFrame(rows, cols), F.lit(day(10))).collect()}
    assert got == {1: (25, "lowered"), 2: (25, "refused"), 3: (0, "cautious")}
