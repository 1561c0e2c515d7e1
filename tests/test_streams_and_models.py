"""Streams against the batch operators, draws against exact probabilities, fits against known parameters."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import goal_model, logs as batch, markets, simulation
from fieldglass.streaming import logs


def test_changes_over_batches_equal_one_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 5, start + dt.timedelta(minutes=i), None if i % 11 == 0 else i * 7 // 20 % 3) for i in range(90)]
    schema = "claim_id long, player_id int, ts timestamp, value int"
    for part in range(3):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # the stream takes the files by their time; write them in order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = logs.changes(stream, "player_id", "value", ["ts", "claim_id"], str(tmp_path / "log"))
    want = batch.changes(spark.createDataFrame(rows, schema), "player_id", "value", ["ts", "claim_id"])
    assert sorted(r["claim_id"] for r in got.collect()) == sorted(r["claim_id"] for r in want.collect())
    assert got.columns == ["claim_id", "player_id", "ts", "value"]


def test_draws_follow_the_grid_whatever_the_partitioning(spark):
    expected = spark.createDataFrame([(1, 1.4, 1.1), (2, 0.3, 3.5)], "match_id long, home double, away double")
    one = simulation.scores(expected.coalesce(1), 4000)
    seven = simulation.scores(expected.repartition(7), 4000)
    assert one.exceptAll(seven).isEmpty() and one.count() == 8000
    exact = {(r["match_id"], r["i"], r["j"]): r["p"] for r in markets.grid(expected).collect()}
    seen = {(r["match_id"], r["i"], r["j"]): r["count"] / 4000 for r in one.groupBy("match_id", "i", "j").count().collect()}
    for cell, p in exact.items():
        assert abs(seen.get(cell, 0) - p) < 5 * np.sqrt(p / 4000) + 1e-3
    half = simulation.half_time(one).agg(F.sum("half_i"), F.sum("i"), F.min(F.col("i") - F.col("half_i"))).first()
    assert half[0] / half[1] == pytest.approx(0.45, abs=0.03) and half[2] >= 0


def test_fit_finds_known_strengths(spark):
    rng, teams = np.random.default_rng(5), 6
    attack, defence = rng.normal(0, 0.3, teams), rng.normal(0, 0.3, teams)
    attack, defence = attack - attack.mean(), defence - defence.mean()
    rows, n = [], 0
    for h in range(teams):
        for a in range(teams):
            if h != a:
                for _ in range(400):
                    rows.append((n, dt.date(2024, 1, 1), 2024, h, a, int(rng.poisson(np.exp(0.1 + 0.25 + attack[h] - defence[a]))), int(rng.poisson(np.exp(0.1 + attack[a] - defence[h])))))
                    n += 1
    schema = "match_id long, match_date date, season int, home_id int, away_id int, fthg int, ftag int"
    matches = spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), schema)
    got = goal_model.fit(matches).orderBy("team").toPandas()
    assert np.abs(got["attack"] - attack).max() < 0.05 and np.abs(got["defence"] - defence).max() < 0.05
    assert got["home_edge"][0] == pytest.approx(0.25, abs=0.03) and abs(got["rho"][0]) < 0.05 and got["steps"].max() < 50
    # no small change of a parameter is more likely
    pairs = goal_model.pair_scores(matches, "season").toPandas()
    *_, rho, best, _ = goal_model.maximise(pairs)
    assert best == pytest.approx(got["log_likelihood"][0]) and rho == pytest.approx(got["rho"][0], abs=1e-6)


def test_fit_refuses_a_team_without_goals(spark):
    rows = [(1, dt.date(2024, 1, 1), 1, 1, 2, 1, 0), (2, dt.date(2024, 1, 2), 1, 2, 1, 0, 2), (3, dt.date(2024, 1, 3), 1, 1, 2, None, None)]
    got = goal_model.fit(spark.createDataFrame(rows, "match_id long, match_date date, season int, home_id int, away_id int, fthg int, ftag int")).collect()
    assert {(r["team"], r["status"], r["attack"]) for r in got} == {(1, "separated", None), (2, "separated", None)}


def test_many_leagues_fit_in_memory_of_their_pairs():
    """100 leagues of 20: the spelt-out matrix would take 76,000 by 4,002 numbers (2.4 GB). A few of them fit as by least squares over the whole matrix."""
    import tracemalloc

    rng = np.random.default_rng(4)
    h, a = (x.ravel() for x in np.meshgrid(range(20), range(20)))
    h, a = h[h != a], a[h != a]
    one = lambda k: pd.DataFrame({"home_id": h + 20 * k, "away_id": a + 20 * k, "n": 3.0, "hg": rng.poisson(4, len(h)) + 0.0, "ag": rng.poisson(3, len(h)) + 0.0, "n00": 0.0, "n01": 0.0, "n10": 0.0, "n11": 0.0})
    pairs = pd.concat([one(k) for k in range(100)], ignore_index=True)
    tracemalloc.start()
    teams, attack, *_ = goal_model.maximise(pairs)
    assert len(teams) == 2000 and np.isfinite(attack).all() and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    few = goal_model.Design(h, a, 20)
    weight, theta = rng.random(2 * len(h)) + 1, rng.normal(size=42)
    x = np.array([few.times(row) for row in np.eye(42)]).T
    gradient = few.turned(weight * few.times(theta))
    assert np.allclose(gradient, x.T @ (weight * (x @ theta)))
    assert np.allclose(few.solve(weight, gradient), np.linalg.lstsq(x.T @ (weight[:, None] * x), gradient, rcond=None)[0], atol=1e-8)
