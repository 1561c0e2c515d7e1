"""Queries over all books and cells, and transfers, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import markets, players, views
from fieldglass.plans.all_queries import QUERIES
from fieldglass.sources import tables as t


def bisect(q, terms, lo, hi):
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(terms(x, mid, sum(q)) for x in q) > 1 else (lo, mid)
    return [terms(x, (lo + hi) / 2, sum(q)) for x in q]


def shin(x, z, total):
    return (math.sqrt(z * z + 4 * (1 - z) * x * x / total) - z) / (2 * (1 - z))


@pytest.mark.parametrize("name, terms, lo, hi", [("f35_devig_power", lambda x, k, total: x**k, 0.5, 10.0), ("f36_devig_shin", shin, 0.0, 0.4)])
def test_every_book_is_devigged(spark, small, name, terms, lo, hi):
    priced = {}
    for r in t.prices(t.matches(spark, small)).collect():
        priced.setdefault((r["match_id"], r["book"]), {})[r["outcome"]] = 1 / r["price"]
    rows = QUERIES[name](spark, small).collect()
    assert sorted((r["match_id"], r["book"]) for r in rows) == sorted(priced) and len({r["book"] for r in rows}) == 5
    for r in rows:
        q = priced[r["match_id"], r["book"]]
        assert [r["p_h"], r["p_d"], r["p_a"]] == pytest.approx(bisect([q[o] for o in "HDA"], terms, lo, hi), abs=1.1e-5)


def test_whole_grid_adds_up(spark, small):
    sums = {}
    for r in QUERIES["f32_scoreline_grid"](spark, small).collect():
        sums.setdefault(r["match_id"], []).append(r["p"])
    assert sums and all(len(p) == 64 and sum(p) == pytest.approx(1, abs=1e-4) for p in sums.values())


def squad(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["DEF", "MID"]), rng.randrange(6), rng.randrange(40, 60), rng.choice([rng.randrange(40) / 4, rng.random() * 10, 3 + rng.random() * 4e-6])) for i in range(900)]
    return rows, rows[:12], spark.createDataFrame(rows, "player_id long, position string, team_id int, price int, xp double")


def test_transfers_are_brute_force(spark):
    rows, owned, df = squad(spark)
    held = {c: sum(r[2] == c for r in owned) for c in range(6)}
    want = []
    for o in owned:
        found = [(-round(i[4] - o[4], 6), i[0]) for i in rows[12:] if i[1] == o[1] and i[3] <= o[3] + 2 and i[4] > o[4] and held[i[2]] - (i[2] == o[2]) < 3]
        want += [(o[0], i, pytest.approx(-g), k + 1) for k, (g, i) in enumerate(sorted(found)[:3])]
    got = players.transfers(df.where("player_id < 12"), df, 2).orderBy("out_id", "rank").collect()
    assert want and list(map(tuple, got)) == want


def test_transfers_join_on_more_than_the_position(spark):
    """An owned player meets the best of each club within its limit: 6 clubs of 3 rows and near ties, not its whole position."""
    _, _, df = squad(spark)
    plan = players.transfers(df.where("player_id < 12"), df, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert any("out_xp" in line and "limit" in line for line in plan.splitlines() if line.lstrip("+- :").startswith("Join Inner"))


def test_transfers_do_not_grow_with_the_clubs(spark):
    """One ranking for all clubs with room; only full clubs are met by club. Of two a club at most, as by brute force."""
    rows, owned, df = squad(spark)
    plan = players.transfers(df.where("player_id < 12"), df, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "in_team" not in "".join(line for line in plan.splitlines() if line.lstrip("+- :").startswith("Window"))
    held = {c: sum(r[2] == c for r in owned) for c in range(6)}
    want = []
    for o in owned:
        found = [(-round(i[4] - o[4], 6), i[0]) for i in rows[12:] if i[1] == o[1] and i[3] <= o[3] + 2 and i[4] > o[4] and held[i[2]] - (i[2] == o[2]) < 2]
        want += [(o[0], i, pytest.approx(-g), k + 1) for k, (g, i) in enumerate(sorted(found)[:3])]
    got = players.transfers(df.where("player_id < 12"), df, 2, per_club=2).orderBy("out_id", "rank").collect()
    assert want and 2 in held.values() and list(map(tuple, got)) == want


def test_points_of_one_place_meet_once(spark):
    """3,000 points and marks on 12 places: 144 pairs of places at most meet, not 9 million."""
    rows = [(n, float(n % 4), float(n % 3)) for n in range(3000)]
    points, marks = spark.createDataFrame(rows, "player_id long, x double, y double"), spark.createDataFrame([(n, x + 0.3, y + 0.2) for n, x, y in rows], "mark_id long, x double, y double")
    df = views.nearest(points, marks, 4.0)
    got = sorted(map(tuple, df.collect()))
    near = lambda x, y: min((math.hypot(px - x, py - y), p) for p, px, py in rows[:12])
    assert [(m, p) for m, p, _ in got] == [(n, near(x + 0.3, y + 0.2)[1]) for n, x, y in rows]
    assert all(far == pytest.approx(near(rows[m][1] + 0.3, rows[m][2] + 0.2)[0]) for m, _, far in got)
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    inner = next(n for n, line in enumerate(plan) if "cx" in line and "Join Inner" in line)
    assert sum("Aggregate" in line for line in plan[inner:]) == 2


def test_plans_meet_their_draws_without_the_driver(spark, small):
    plan = QUERIES["o7_o8_plan_values"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_scoreline_loss_makes_one_score_a_match(spark, small):
    """No rows a score: the chance of each score is the grid's, and null beyond it."""
    assert "Generate" not in QUERIES["e7_scoreline_loss"](spark, small)._jdf.queryExecution().executedPlan().toString()
    rates = spark.createDataFrame([(1, 1.4, 0.9), (2, 3.9, 3.8)], "match_id long, home double, away double")
    want = {(r["match_id"], r["i"], r["j"]): r["p"] for r in markets.grid(rates).collect()}
    goals = spark.createDataFrame([(i, j) for i in range(9) for j in range(9)], "i int, j int")
    for r in markets.score_chance(rates.crossJoin(goals), F.col("i"), F.col("j")).collect():
        found = want.get((r["match_id"], r["i"], r["j"]))
        assert r["p"] is None if found is None else r["p"] == pytest.approx(found, rel=1e-12)
