"""Implied rates against known ones, statuses of bad markets, value bets against a plain loop."""

import numpy as np
import pandas as pd
import pytest

from fieldglass.operators import inversion as iv, value as vl

RESULTS, TOTALS = "match_id long, p_h double, p_a double, weight double, dispersion double", "match_id long, line double, p_over double, weight double, dispersion double"


def market(home, away, rho=-0.05, lines=(1.5, 2.5, 3.5)):
    cells = iv.scores(np.array([home]), np.array([away]), np.array([rho]))[0]
    i, j = np.indices(cells.shape)
    return cells[i > j].sum(), cells[i < j].sum(), {x: cells[i + j > x].sum() for x in lines}


@pytest.mark.parametrize("parts", [1, 4])
def test_known_rates_are_found_again(spark, parts):
    rng = np.random.default_rng(2)
    known = {m: (float(rng.uniform(0.3, 3.2)), float(rng.uniform(0.3, 3.2))) for m in range(60)}
    results, totals = [], []
    for m, (h, a) in known.items():
        p_h, p_a, over = market(h, a, lines=(2.5,) if m % 3 == 0 else (1.5, 2.5, 3.5))
        results.append((m, float(p_h), float(p_a), 1.0, 0.1))
        totals += [(m, x, float(p), 0.6, 0.02 + x / 10) for x, p in over.items()]
    got = iv.market_rates(spark.createDataFrame(results, RESULTS).repartition(parts), spark.createDataFrame(totals, TOTALS)).collect()
    assert len(got) == 60
    for r in got:
        assert r["status"] == "converged" and (r["home"], r["away"]) == pytest.approx(known[r["match_id"]], abs=1e-5)
        assert r["residual"] < 1e-6 and r["weight"] == pytest.approx(0.6) and r["constraints"] == (3 if r["match_id"] % 3 == 0 else 5)


def test_a_fit_is_the_least_of_the_weighted_squares(spark):
    results, totals = [(1, 0.5, 0.25, 1.0, 0.2)], [(1, 2.5, 0.62, 1.0, 0.05), (1, 3.5, 0.30, 0.33, 0.3), (1, 1.5, 0.70, 0.33, 0.3)]
    r = iv.market_rates(spark.createDataFrame(results, RESULTS), spark.createDataFrame(totals, TOTALS)).first()
    target = iv._logit(np.array([[0.5, 0.25, 0.70, 0.62, 0.30]]))
    pull = np.array([[5.0, 5.0, 0.33 / 0.3, 20.0, 0.33 / 0.3]])

    def loss(home, away):
        off = pull * (iv.modelled(np.log([home + away]), np.log([home / away]), np.array([-0.05]), np.array([[1.5, 2.5, 3.5]])) - target)
        return float((off * off).sum())

    best = loss(r["home"], r["away"])
    assert all(best <= loss(r["home"] * (1 + dh), r["away"] * (1 + da)) for dh in (-1e-3, 0, 1e-3) for da in (-1e-3, 0, 1e-3))


def test_statuses(spark):
    even, lop = market(1.4, 1.1), market(2.4, 0.6)
    wild = market(4.9, 4.9)
    results = [(1, float(even[0]), float(even[1]), 1.0, 0.1), (2, None, None, 1.0, 0.1), (3, 0.97, 0.96, 1.0, 0.1), (4, float(lop[0]), float(lop[1]), 1.0, 0.1), (5, 0.9999, 0.00001, 1.0, 0.1), (6, float(even[0]), float(even[1]), 1.0, 0.1), (7, float(wild[0]), float(wild[1]), 1.0, 0.1)]
    totals = [(m, x, float(p), 1.0, 0.1) for m, (_, _, over) in ((1, even), (2, even), (3, even), (4, lop), (5, lop), (7, wild)) for x, p in over.items()] + [(6, 2.5, None, 1.0, 0.1)]
    leads = spark.createDataFrame([(4, -1.0), (1, -1.0)], "match_id long, lead double")
    got = {r["match_id"]: r for r in iv.market_rates(spark.createDataFrame(results, RESULTS), spark.createDataFrame(totals, TOTALS), leads=leads).collect()}
    assert {m: r["status"] for m, r in got.items() if m not in (5, 7)} == {1: "converged", 2: "absent", 3: "not_converged", 4: "rejected_supremacy_sign", 6: "absent"}
    assert got[5]["status"] in ("rejected_implausible_rate", "not_converged")
    assert got[2]["home"] is None and got[3]["weight"] == 0 and got[4]["weight"] == 0 and got[1]["weight"] == 1
    assert iv.market_rates(spark.createDataFrame([], RESULTS), spark.createDataFrame([], TOTALS)).collect() == []


def test_value_bets_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    chances, quotes = [], []
    for m in range(80):
        for k, line, outs in (("1x2", None, "HDA"), ("corners", 9.5, "ou"), ("corners", 10.5, "ou"), ("player_booked", None, "y"), ("other", None, "ab")):
            p = rng.dirichlet(np.ones(len(outs))) if len(outs) > 1 else np.array([0.3])
            for o, x in zip(outs, p):
                chances.append((m, k, line, o, float(x)))
                for b in range(2):
                    if rng.random() < 0.85:
                        quotes.append((m, k, line, o, b, float(round(rng.choice([0.9, 1.0, rng.uniform(1.05, 9)]), 2))))
    rows = vl.value_bets(spark.createDataFrame(chances, "match_id long, market string, line double, outcome string, p double"), vl.best_quotes(spark.createDataFrame(quotes, "match_id long, market string, line double, outcome string, book int, price double"))).collect()
    best = {}
    for m, k, line, o, b, price in quotes:
        if price > 1 and (best.get((m, k, line), {}).get(o, (0,))[0] < price):
            best.setdefault((m, k, line), {})[o] = (price, b)
    want = {}
    for m, k, line, o, p in chances:
        side = best.get((m, k, line), {})
        if o in side:
            price, b = side[o]
            implied = 1 / price / sum(1 / q for q, _ in side.values()) if len(side) > 1 else 1 / price
            kelly, bar = ((price - 1) * p - (1 - p)) / (price - 1), vl.THRESHOLDS.get(k, 0.05)
            if kelly > 0 and p - implied >= bar:
                want[m, k, line, o] = (b, p - implied, min(kelly, 0.05), "high" if p - implied >= 2.5 * bar else "medium" if p - implied >= 1.5 * bar else "low")
    assert {(r["match_id"], r["market"], r["line"], r["outcome"]) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        b, edge, stake, tier = want[r["match_id"], r["market"], r["line"], r["outcome"]]
        assert (r["book"], r["tier"]) == (b, tier) and (r["edge"], r["stake"], r["half_stake"]) == pytest.approx((edge, stake, stake / 2))
    assert any(r["market"] == "player_booked" for r in rows) and pd.Series([r["tier"] for r in rows]).nunique() == 3


def test_log_odds_without_the_grid_are_those_of_the_grid(monkeypatch):
    """Whole, half and quarter lines and lines out of reach; corrections that are cut at 0. No fit spells out a grid."""
    rng = np.random.default_rng(6)
    home, away, rho = rng.uniform(0.1, 6, 60), rng.uniform(0.1, 6, 60), rng.choice([-0.3, -0.05, 0.0, 0.4], 60)
    lines = np.tile([-1.0, 0.5, 2.0, 2.25, 2.5, 7.5, 19.5, 25.0], (60, 1))
    cells = iv.scores(home, away, rho)
    i, j = np.indices(cells.shape[1:])
    chances = [cells[:, i > j].sum(1), cells[:, i < j].sum(1), *[cells[:, i + j > line].sum(1) for line in lines[0]]]
    monkeypatch.setattr(iv, "scores", lambda *_: pytest.fail("a grid a match"))
    got = iv.modelled(np.log(home + away), np.log(home / away), rho, lines)
    assert np.allclose(1 / (1 + np.exp(-got)), np.clip(np.stack(chances, 1), 1e-9, 1 - 1e-9), atol=1e-12)
