"""Draws are made where the matches have been dealt out to."""

from fieldglass.operators import simulation
from fieldglass.plans.all_queries import QUERIES
from fieldglass.plans.simulation import DRAWS, QUERIES_OF_DRAWS as NAMES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_matches_are_dealt_out_before_they_are_drawn(spark, small):
    for name in NAMES:
        lines = plan(QUERIES[name](spark, small))
        first = max(n for n, line in enumerate(lines) if "MapInArrow" in line)
        assert any("REPARTITION_BY_NUM" in line for line in lines[first : first + 4]), name


def test_rounds_are_those_of_single_scores(spark):
    expected = spark.createDataFrame([(m, 0.5 + m / 10, 2.0 - m / 10) for m in range(12)], "match_id long, home double, away double")
    fixtures = spark.createDataFrame([(m, m // 4, m % 3, 3 + m % 2) for m in range(12)], "match_id long, round int, home_id int, away_id int")
    want = simulation.round_points(simulation.scores(expected, DRAWS), fixtures)
    assert sorted(simulation.simulated_rounds(expected, fixtures, DRAWS).collect()) == sorted(want.select("round", "team", "matches", "mean", "sd", "p_ge_3", "q90").collect())


def test_rounds_are_added_up_where_they_are_drawn(spark):
    """The points of a team's round are those of its draws joined and added up; one shuffle by team and round, and no draw in it."""
    rates = spark.createDataFrame([(k, 0.5 + k % 7 / 3, 0.4 + k % 5 / 3) for k in range(900)], "match_id long, home double, away double")
    fixtures = spark.createDataFrame([(k, None if k % 50 == 0 else k % 4, k % 11, 11 + k % 3) for k in range(900)], "match_id long, round int, home_id int, away_id int")
    out = simulation.simulated_rounds(rates, fixtures, 20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan[: plan.index("MapInArrow")].count("Exchange") == 0
    want = simulation.round_points(simulation.scores(rates, 20), fixtures)
    key = lambda r: (r["round"] is None, r["round"] or 0, r["team"])
    got, want = sorted(out.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want) > 50 and max(r["matches"] for r in got) > 60
    assert all(tuple(a)[:3] == tuple(b)[:3] and all(abs(x - y) <= 1.01e-6 for x, y in zip(tuple(a)[3:], tuple(b)[3:])) for a, b in zip(got, want))
