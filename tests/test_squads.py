"""Substitutions and captains by a plain loop, transfer plans by trying all, gates, samples and stripped documents by plain versions."""

import hashlib
import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import gates as gt, samples as sp, squads as sq

BOUNDS = {"GKP": (1, 1), "DEF": (3, 5), "MID": (2, 5), "FWD": (1, 3)}
SQUAD = "squad int, player_id long, position string, starts boolean, place int, played boolean, points long, role string, chip string"


def lineup(rng, squad):
    d, m, f = rng.choice([(3, 4, 3), (3, 5, 2), (4, 4, 2), (4, 3, 3), (5, 3, 2), (5, 4, 1), (5, 2, 3)])
    rows, ids = [], list(range(squad * 100, squad * 100 + 15))
    rng.shuffle(ids)
    starters = ["GKP"] + ["DEF"] * d + ["MID"] * m + ["FWD"] * f
    rest = ["DEF"] * (5 - d) + ["MID"] * (5 - m) + ["FWD"] * (3 - f)
    rng.shuffle(rest)
    captain, vice = rng.sample(range(11), 2)
    chip = rng.choice([None, None, None, "bench_boost", "triple_captain"])
    for k, position in enumerate(starters + ["GKP"] + rest):
        rows.append((squad, ids[k], position, k < 11, k + 1 if k < 11 else k - 10, rng.random() < 0.6, rng.randrange(-2, 15), "captain" if k == captain else "vice" if k == vice else None, chip))
    return rows


def plain(rows):
    eleven = sorted((r for r in rows if r[3]), key=lambda r: r[4])
    bench = sorted((r for r in rows if not r[3]), key=lambda r: r[4])
    chip, subs = rows[0][8], []
    if chip == "bench_boost":
        counted = eleven + bench
    else:
        counted = eleven
        for new in bench:
            for i, old in enumerate(counted):
                if new[5] and not old[5]:
                    trial = counted[:i] + [new] + counted[i + 1 :]
                    if all(lo <= sum(r[2] == p for r in trial) <= hi for p, (lo, hi) in BOUNDS.items()):
                        counted = trial
                        subs.append((old[1], new[1]))
                        break
    captain, vice = (next(r for r in rows if r[7] == role) for role in ("captain", "vice"))
    used = not captain[5] and vice[5]
    band, times = (vice if used else captain)[1], 3 if chip == "triple_captain" else 2
    return [r[1] for r in counted], subs, band, times, used, sum(r[6] * (times if r[1] == band else 1) for r in counted)


def test_lineups_are_a_plain_loop(spark):
    rng = random.Random(6)
    squads = {k: lineup(rng, k) for k in range(300)}
    rows = [r for s in squads.values() for r in s]
    rng.shuffle(rows)
    got = sq.resolved_lineups(spark.createDataFrame(rows, SQUAD).repartition(5), "squad").collect()
    assert len(got) == 300
    for r in got:
        assert (list(r["counted"]), [tuple(x) for x in r["subs"]], r["captain"], r["multiplier"], r["vice_used"], r["total"]) == plain(squads[r["squad"]])
    assert sum(bool(r["subs"]) for r in got) > 150 and any(r["vice_used"] for r in got)
    assert sq.resolved_lineups(spark.createDataFrame([], SQUAD), "squad").collect() == []


def test_appearing(spark):
    rows = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], "m int, y int, r int").coalesce(1)
    assert [r[0] for r in rows.select(sq.appeared(F.col("m"), F.col("y"), F.col("r"))).collect()] == [False, True, True, True]


PLAYER = "league int, player_id long, position string, team_id int, price int, xp double"


def exhaustive(squad, market, bank, depths):
    """{depth: {ids: (delta, bank)}} of every chain of gaining moves."""
    states, out = {(tuple(sorted(p["player_id"] for p in squad)), ()): (squad, bank, 0.0, frozenset(), frozenset())}, {}
    for depth in range(1, depths + 1):
        after = {}
        for team, money, delta, sold, bought in states.values():
            for old in team:
                for new in market:
                    clubs = sum(p["team_id"] == new["team_id"] for p in team) + (new["team_id"] != old["team_id"])
                    if old["player_id"] in bought or new["position"] != old["position"] or new["player_id"] in {p["player_id"] for p in team} | sold or new["price"] > old["price"] + money or clubs > 3:
                        continue
                    gain = round(delta + new["xp"] - old["xp"], 6)
                    if gain > 0:
                        moved = [new if p is old else p for p in team]
                        s, b = sold | {old["player_id"]}, bought | {new["player_id"]}
                        after[tuple(sorted(p["player_id"] for p in moved)), (s, b)] = (moved, money + old["price"] - new["price"], gain, s, b)
        states, out[depth] = after, {k[0]: (v[2], v[1]) for k, v in after.items()}
    return out


def test_plans_are_the_best_of_all(spark):
    rng = random.Random(2)
    market = [(k % 2, k, rng.choice(["DEF", "FWD"]), rng.randrange(6), rng.randrange(40, 60), rng.randrange(1, 1000) / 100 + k / 1e5) for k in range(36)]
    rows = [dict(zip(("league", "player_id", "position", "team_id", "price", "xp"), p)) for p in market]
    squads = {s: rng.sample([p for p in rows if p["league"] == s % 2], 5) for s in range(3)}
    own = spark.createDataFrame([(s, *p.values()) for s, team in squads.items() for p in team], f"squad int, {PLAYER}")
    banks = spark.createDataFrame([(s, 4) for s in squads], "squad int, bank int")
    got = sq.transfer_plans(own, spark.createDataFrame(market, PLAYER), banks, "squad", "league", beam=100_000).collect()
    for s, team in squads.items():
        want = exhaustive(team, [p for p in rows if p["league"] == s % 2], 4, 3)
        for depth in (2, 3):
            best = sorted(want[depth].values(), reverse=True)[: sq.PLANS]
            mine = sorted(((r["delta"], r["bank"]) for r in got if r["squad"] == s and r["depth"] == depth), reverse=True)
            assert len(mine) == len(best) > 3 and np.allclose(mine, best, atol=1e-5)
    for r in got:
        ids = {p["player_id"] for p in squads[r["squad"]]}
        for m in r["moves"]:
            assert m["out_id"] in ids and m["in_id"] not in ids
            ids = ids - {m["out_id"]} | {m["in_id"]}


def test_plans_take_the_whole_market(spark):
    """No player is too far down the market, and no plan's start too poor: 60 of a position, all but one of a club that is full, and a search that goes on from one state."""
    rng = random.Random(7)
    market = [(0, k, "DEF" if k % 2 else "FWD", 0 if k < 100 else k, rng.randrange(40, 60), 9 - k / 1e3 if k < 100 else rng.randrange(1, 800) / 100) for k in range(120)]
    rows = [dict(zip(("league", "player_id", "position", "team_id", "price", "xp"), p)) for p in market]
    team = [{**r, "xp": r["xp"] / 8} for r in (*rows[:3], *rows[110:113])]
    own = spark.createDataFrame([(1, *p.values()) for p in team], f"squad int, {PLAYER}")
    whole = [next((p for p in team if p["player_id"] == r["player_id"]), r) for r in rows]
    banks = spark.createDataFrame([(1, 3)], "squad int, bank int")
    for beam in (1, 140):
        got = sq.transfer_plans(own, spark.createDataFrame([tuple(r.values()) for r in whole], PLAYER), banks, "squad", "league", beam=beam).collect()
        want = exhaustive(team, whole, 3, 3)
        for depth in (2, 3):
            best = sorted(want[depth].values(), reverse=True)[: sq.PLANS]
            mine = [(r["delta"], r["bank"]) for r in sorted(got, key=lambda r: r["rank"]) if r["depth"] == depth]
            assert len(mine) == len(best) == sq.PLANS and np.allclose(mine, best, atol=1e-5)


def test_plans_shuffle_a_row_a_squad(spark):
    """Each level's states stay in the task: the plan is one job without written levels, and squads are dealt over all partitions."""
    rows = [(s, s // 20, 100 * s + k, "DEF" if k % 2 else "FWD", 7 * s + k % 9, 50 + k, k / 7) for s in range(40) for k in range(6)]
    own = spark.createDataFrame(rows, f"squad int, {PLAYER}")
    market = spark.createDataFrame([(k % 2, 10_000 + k, "DEF" if k % 4 < 2 else "FWD", k, 50, k / 3) for k in range(60)], PLAYER)
    out = sq.transfer_plans(own, market, own.select("squad").distinct().withColumn("bank", F.lit(20)), "squad", "league")
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.select("squad").distinct().count() == 40 and not any("parquet" in f for f in out.inputFiles())


# --- gates


def test_effective_samples(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key, shared in (("apart", 0.0), ("alike", 3.0)):
        for block in range(60):
            level = rng.normal(0, shared)
            rows += [(key, block, float(level + rng.normal())) for _ in range(5 + block % 3)]
    rows += [("same", b, float(b)) for b in range(10) for _ in range(4)] + [("single", 0, 1.0), ("single", 0, 2.0), ("single", 0, None)]
    got = {r["key"]: r for r in gt.effective_samples(spark.createDataFrame(rows, "key string, block int, value double").repartition(3), "key", "block", "value").collect()}
    for key in ("apart", "alike"):
        groups = defaultdict(list)
        for k, b, v in rows:
            if k == key:
                groups[b].append(v)
        m, n = np.array([len(g) for g in groups.values()]), sum(map(len, groups.values()))
        grand = sum(map(sum, groups.values())) / n
        within = sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups.values()) / (n - len(groups))
        between = sum(len(g) * (np.mean(g) - grand) ** 2 for g in groups.values()) / (len(groups) - 1)
        size = (n - (m * m).sum() / n) / (len(groups) - 1)
        rho = min(1.0, max(0.0, (between - within) / (between + (size - 1) * within)))
        assert got[key]["n"] == n and got[key]["correlation"] == pytest.approx(rho) and got[key]["effective"] == pytest.approx(n / (1 + ((m * m).sum() / n - 1) * rho))
    assert got["apart"]["effective"] > 0.8 * got["apart"]["n"] and got["alike"]["effective"] < 80
    assert (got["same"]["correlation"], got["same"]["effective"]) == (1.0, pytest.approx(10)) and got["single"]["effective"] == pytest.approx(1)


def test_promotions(spark):
    registry = spark.createDataFrame([("a", 0.0, 1.0, "F"), ("b", 0.0, 1.0, "C"), ("risk.c", 0.0, 1.0, "F"), ("d", 0.0, 1.0, "S")], "name string, low double, high double, tier string")
    moves = spark.createDataFrame([("a", "x", 0.5, 0.6), ("b", "y", 0.5, 0.6), ("risk.c", "z", 0.5, 0.9), ("d", "w", 0.5, 1.2), ("e", "v", 0.1, 0.1)] + [(f"m{k}", "many", 0.0, 0.0) for k in range(5)], "name string, block string, current double, proposed double")
    samples = spark.createDataFrame([(n, 600.0) for n in ("a", "b", "risk.c")], "name string, effective double")
    days = [(n, 1.0 + (k % 3) / 10) for n in ("a", "b", "risk.c") for k in range(40)] + [("d", 5.0)] * 9 + [("d", None)]
    gains = gt.out_of_sample(spark.createDataFrame(days, "name string, gain double"), "name", "gain")
    got = {r["name"]: (r["failed"], r["promoted"]) for r in gt.promotions(moves, registry, samples, gains).collect()}
    assert got["a"] == ("", True) and got["b"] == ("tier", False) and got["risk.c"] == ("not_risk move_size", False)
    assert got["d"] == ("bounds move_size effective_sample out_of_sample", False) and got["m0"][0] == "registered tier bounds move_size block_size effective_sample out_of_sample"
    lower = {r["name"]: r["lower"] for r in gains.collect()}
    x = np.array([v for n, v in days if n == "a"])
    assert lower["d"] is None and lower["a"] == pytest.approx(x.mean() - x.std(ddof=1) * math.sqrt(2 * 41 / 1600 * math.log(math.sqrt(41) / 0.01)))


# --- samples and documents


@pytest.mark.parametrize("parts", [1, 6])
def test_samples_depend_on_keys_alone(spark, parts):
    rows = [(i, "a" if i % 3 else None, i * 7 % 50) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id long, bucket string, v int").repartition(parts)
    out = sp.bucket_samples(frame, ["bucket"], "id", "v", 20)
    for r in out.collect():
        own = [x for x in rows if x[1] == r["bucket"]]
        assert list(r["sample"]) == [x[2] for x in sorted(own, key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest())[:20]]
        assert r["n"] == len(own) and r["mean"] == pytest.approx(sum(x[2] for x in own) / len(own))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # each task keeps its own first before the shuffle


def test_stripping_at_any_depth(spark):
    secret = {"entry_id": 1, "b": [{"entry_id": 2, "x": [[{"runners_up": 3, "y": "é"}]]}, 5, None], "a": {"manager_name": "m", "deep": {"counterfactuals": {"entry_id": 1}}}}
    rows = [(1, json.dumps(secret)), (2, '{"x": NaN}'), (3, "[1, {\"entry_id\": 2}]"), (4, None), (5, "nonsense"), (6, '"entry_id"'), (7, json.dumps({"a": secret["a"], "b": secret["b"], "entry_id": 1}))]
    got = {r["id"]: (r["s"], r["d"]) for r in spark.createDataFrame(rows, "id int, t string").select("id", sp.stripped(F.col("t")).alias("s"), sp.digest(F.col("t")).alias("d")).collect()}
    assert got[1][0] == '{"a":{"deep":{}},"b":[{"x":[[{"y":"é"}]]},5,null]}' and got[3][0] == "[1,{}]" and got[6][0] == '"entry_id"'
    assert got[2] == got[4] == got[5] == (None, None) and got[1][1] == got[7][1] != got[3][1] and len(got[1][1]) == 16
