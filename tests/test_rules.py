"""Operators without SQL against plain loops."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import quantiles, rates_model as rm, risk, views
from fieldglass.plans import markets as market_plans, models, views as view_plans
from fieldglass.plans.all_queries import QUERIES
from fieldglass.sources import files


def test_portfolio_is_a_plain_loop_over_every_card(spark, small):
    bets = market_plans.all_bets(spark, small).collect()
    cards = defaultdict(list)
    for b in bets:
        cards[str(b["match_date"])].append(b)
    want, clipped = [], 0
    for rows in cards.values():
        used = defaultdict(float)
        for b in sorted(rows, key=lambda b: (-b["edge"], b["match_id"], b["outcome"])):
            caps = [(("total",), 0.20), (("match", b["match_id"]), 0.15), (("market", b["market"]), 0.40), (("direction", b["outcome"]), 0.10)]
            if b["team"] is not None:
                caps.append((("team", b["team"]), 0.30))
            if b["nest"] is not None:
                caps.append((("nested", b["nest"]), 0.025))
            stake = min([b["stake"]] + [max(0.0, cap - used[k]) for k, cap in caps])
            if stake > 0:
                want.append((b["match_id"], b["outcome"], round(stake, 6)))
                clipped += stake < b["stake"]
                for k, _ in caps:
                    used[k] += stake
    got = [(r["match_id"], r["outcome"], r["stake"]) for r in QUERIES["r5_portfolio_limits"](spark, small).collect()]
    assert sorted(got) == [(m, o, pytest.approx(s, abs=1.1e-6)) for m, o, s in sorted(want)]
    assert clipped and {b["market"] for b in bets} == {"1x2", "goals"}


BOUNDS = {"GKP": (1, 1), "DEF": (3, 5), "MID": (2, 5), "FWD": (1, 3)}


def plain_autosubs(rows):
    eleven = [dict(r, open=not r["played"]) for r in rows if r["starts"]]
    came = []
    for b in sorted((r for r in rows if not r["starts"] and r["played"]), key=lambda r: r["bench"]):
        gaps = [e for e in eleven if e["open"]]
        same = [e for e in gaps if e["position"] == b["position"]]
        out = same[0] if same else None
        if out is None and b["position"] != "GKP":
            for p in ("DEF", "MID", "FWD"):
                if p == b["position"]:
                    continue
                found = [e for e in gaps if e["position"] == p]
                size = lambda q: sum(e["position"] == q for e in eleven)
                if found and size(p) - 1 >= BOUNDS[p][0] and size(b["position"]) + 1 <= BOUNDS[b["position"]][1]:
                    out = found[0]
                    break
        if out is not None:
            eleven.remove(out)
            eleven.append(dict(b, open=False))
            came.append(b["player_id"])
    return came


def test_autosubs_are_a_plain_loop(spark):
    rng, rows = random.Random(3), []
    for squad in range(120):
        d = rng.randint(3, 5)
        m = rng.randint(max(2, 10 - d - 3), min(5, 9 - d))
        starters = {"GKP": 1, "DEF": d, "MID": m, "FWD": 10 - d - m}
        if not 1 <= starters["FWD"] <= 3:
            continue
        bench = 0
        for p, n in {"GKP": 2, "DEF": 5, "MID": 5, "FWD": 3}.items():
            for k in range(n):
                starts = k < starters[p]
                bench += not starts
                rows.append((squad, len(rows), p, starts, bench, rng.random() < 0.7))
    df = spark.createDataFrame(rows, "squad int, player_id long, position string, starts boolean, bench int, played boolean")
    got = defaultdict(list)
    for r in views.autosubs(df, "squad").collect():
        got[r["squad"]].append(r["in_id"])
    want = defaultdict(list)
    for squad in {r[0] for r in rows}:
        came = plain_autosubs([dict(zip(("squad", "player_id", "position", "starts", "bench", "played"), r)) for r in rows if r[0] == squad])
        if came:
            want[squad] = sorted(came)
    assert {k: sorted(v) for k, v in got.items()} == dict(want) and len(want) > 20
    assert view_plans.o6(spark, "/root/testdata/sf0.001").columns == ["team_id", "in_id"]


def test_calibrations(spark):
    rng = random.Random(1)
    rows = [(i, p := rng.random(), int(rng.random() < p * p)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, p double, y int")
    for fit in (rm.platt, rm.isotonic):
        out = fit(df).orderBy("p").collect()
        assert all(x["calibrated"] <= y["calibrated"] + 1e-9 for x, y in zip(out, out[1:]))
        loss = lambda c: sum((r[c] - r["y"]) ** 2 for r in out)
        assert loss("calibrated") < loss("p")
        assert [r["calibrated"] for r in fit(df.limit(20)).collect()] == [r["p"] for r in fit(df.limit(20)).collect()]


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [1.0] * 500 + [2.0] * 500, [float(i * i % 977) for i in range(5000)], []])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    for q in (0.0, 0.25, 0.5, 0.75, 0.999, 1.0):
        want = df.agg(F.percentile("x", F.lit(q))).first()[0]
        got = quantiles.quantile(df, "x", q, "m").first()[0]
        assert got == want or got == pytest.approx(want)


def test_limits_of_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_seasons(spark, {"1": str(tmp_path / "none")}, strict=True)
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id int, at timestamp")
    files.seal(df, str(tmp_path / "seal"), F.col("at"), F.lit("2024-02-01").cast("timestamp"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.seal(df, str(tmp_path / "seal"), F.col("at"), F.lit("2024-02-01").cast("timestamp"))
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        files.read_lines(spark, str(tmp_path / "log"), "a int", "fail").collect()


def test_regression_rates_are_positive_and_keep_the_mean(spark, small):
    goals = models.labelled(spark, small).agg(F.avg("fthg")).first()[0]
    rates = [r["rate"] for r in QUERIES["m5_goal_regression"](spark, small).collect()]
    assert all(r > 0 for r in rates) and sum(rates) / len(rates) == pytest.approx(goals, rel=0.02)


def test_single_cap_stays(spark):
    bets = spark.createDataFrame([(1, "H", 0.3, 0.05), (1, "D", 0.2, 0.05), (1, "A", 0.1, 0.05)], "match_id long, outcome string, edge double, stake double")
    assert [round(r["stake"], 6) for r in risk.single_cap(bets, ["match_id"], 0.06).orderBy(F.desc("stake")).collect()] == [0.05, 0.01, 0.0]
