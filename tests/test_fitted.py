"""Fits that never see what they forecast, against plain versions of themselves."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import boosting, folds, goal_model, walking
from fieldglass.operators.folds import Base
from fieldglass.plans import fitted
from fieldglass.sources import tables as t

A, B, Y, GOALS = ("a", "b"), ("c",), "y", "goals"


def table(seed=1, n=700):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3))
    goals = rng.poisson(np.exp(0.3 + 0.5 * x[:, 0] - 0.25 * x[:, 1]))
    at = np.stack((np.zeros(n), 0.4 + 0.8 * x[:, 2], -0.2 - 0.6 * x[:, 2]), 1)
    p = np.exp(at) / np.exp(at).sum(1, keepdims=True)
    y = (p.cumsum(1) < rng.random((n, 1))).sum(1)
    return pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "goals": goals.astype(float), "y": y.astype(float), "season": [f"s{i % 4}" for i in range(n)]})


def spark_table(spark, frame, parts=3):
    return spark.createDataFrame(frame).withColumns({c: F.nullif(c, F.lit(float("nan"))) for c in ("a", "b", "c", "goals", "y")}).repartition(parts)


def newton(x, y, family, size, ridge):
    beta = np.zeros(size)
    for _ in range(40):
        _, g, h = family(x, y, beta)
        beta = beta + np.linalg.solve(h + ridge * np.eye(size), g - ridge * beta)
    return beta


def ones(frame, columns):
    return np.hstack((frame[list(columns)].to_numpy(), np.ones((len(frame), 1))))


@pytest.mark.parametrize("parts", [1, 5])
def test_each_season_is_forecast_by_a_fit_on_the_others(spark, parts):
    frame = table()
    got = folds.season_forecasts(spark_table(spark, frame, parts), Base(A, GOALS, "poisson"), "season").orderBy("id").toPandas()["rate"]
    out = folds.season_forecasts(spark_table(spark, frame, parts), Base(B, Y, "multinomial"), "season").orderBy("id").toPandas()
    for s in frame["season"].unique():
        own, rest = frame[frame["season"] == s], frame[frame["season"] != s]
        beta = newton(ones(rest, A), rest["goals"].to_numpy(), folds.poisson, 3, 1e-4)
        assert np.allclose(got[own.index], np.exp(ones(own, A) @ beta), rtol=1e-6)
        assert np.allclose(beta, [0.5, -0.25, 0.3], atol=0.12)
        beta = newton(ones(rest, B), rest["y"].to_numpy(), folds.multinomial, 4, 1e-4).reshape(2, 2)
        at = np.hstack((np.zeros((len(own), 1)), ones(own, B) @ beta.T))
        assert np.allclose(out.loc[own.index, ["p_0", "p_1", "p_2"]], np.exp(at) / np.exp(at).sum(1, keepdims=True), rtol=1e-6)


BASES = [Base(A, GOALS, "poisson"), Base(B, Y, "multinomial")]


def test_no_row_is_scored_by_a_model_that_saw_its_season(spark):
    frame = table()
    other = frame.copy()
    own = other["season"] == "s2"
    other.loc[own, "y"], other.loc[own, "goals"] = (other.loc[own, "y"] + 1) % 3, 40.0
    one, two = (folds.stacked(spark_table(spark, f), BASES, Y, "season").orderBy("id").select("p_0", "p_1", "p_2").toPandas().to_numpy() for f in (frame, other))
    assert np.abs(one - two)[own].max() < 1e-9 and np.abs(one - two)[~own].max() > 0.05
    assert np.allclose(one.sum(1), 1)
    # better than the shares of the outcomes, which the first model alone does not know
    y, shares = frame["y"].astype(int), frame["y"].value_counts(normalize=True).sort_index().to_numpy()
    assert -np.log(one[range(len(y)), y]).mean() < -np.log(shares[y]).mean() - 0.02


def test_stacked_is_the_plain_nested_fit(spark):
    frame = table(3, 400)
    got = folds.stacked(spark_table(spark, frame), BASES, Y, "season", ridge=1e-2).orderBy("id").select("p_0", "p_1", "p_2").toPandas().to_numpy()

    def base(rest, rows):
        goals = newton(ones(rest, A), rest["goals"].to_numpy(), folds.poisson, 3, 1e-2)
        odds = newton(ones(rest, B), rest["y"].to_numpy(), folds.multinomial, 4, 1e-2).reshape(2, 2)
        return np.hstack(((ones(rows, A) @ goals)[:, None], ones(rows, B) @ odds.T, np.ones((len(rows), 1))))

    for s in frame["season"].unique():
        own, rest = frame[frame["season"] == s], frame[frame["season"] != s]
        z = pd.concat([pd.DataFrame(base(rest[rest["season"] != u], rest[rest["season"] == u]), index=rest[rest["season"] == u].index) for u in rest["season"].unique()]).loc[rest.index]
        beta = newton(z.to_numpy(), rest["y"].to_numpy(), folds.multinomial, 8, 1e-2).reshape(2, 4)
        at = np.hstack((np.zeros((len(own), 1)), base(rest, own) @ beta.T))
        assert np.allclose(got[own.index], np.exp(at) / np.exp(at).sum(1, keepdims=True), atol=1e-6)


def test_rows_with_gaps(spark):
    frame = table(2, 120)
    frame.loc[0, "y"], frame.loc[1, "a"], frame.loc[2, "season"] = np.nan, np.nan, None
    out = folds.stacked(spark_table(spark, frame), BASES, Y, "season").orderBy("id").collect()
    assert len(out) == 120 and out[0]["p_0"] is not None and out[1]["p_0"] is None and out[2]["p_0"] is None
    empty = folds.season_forecasts(spark_table(spark, frame).limit(0), BASES[0], "season")
    assert empty.collect() == [] and "rate" in empty.columns


# --- walking forward


def results(seed=6, rounds=18, teams=6, leagues=2):
    rng, rows = np.random.default_rng(seed), []
    for league in range(leagues):
        strength = rng.normal(0, 0.3, teams)
        for r in range(rounds):
            order = rng.permutation(teams)
            for k in range(0, teams, 2):
                h, a = (int(i) + 20 * league for i in order[k : k + 2])
                day = dt.date(2024, 1, 1) + dt.timedelta(7 * r + int(rng.integers(3)))
                goals = [int(rng.poisson(np.exp(0.4 + strength[h % 20] - strength[a % 20]))), int(rng.poisson(np.exp(0.1 + strength[a % 20] - strength[h % 20])))]
                rows.append((len(rows), day, r, h, a, *(goals if rng.random() > 0.05 else [None, None])))
    rows.append((len(rows), dt.date(2024, 4, 1), 12, 19, 1, 1, 1))
    return rows


def test_walking_forward_equals_refitting_from_all_earlier_rows(spark):
    rows, decay = results(), 0.004
    schema = "match_id long, match_date date, round int, home_id int, away_id int, fthg int, ftag int"
    matches = spark.createDataFrame(rows, schema)
    got = {(r["round"], r["home_id"], r["away_id"]): r for r in walking.walk_forward(matches.repartition(3), F.expr("home_id div 20"), F.col("round"), decay, 12).collect()}
    assert got.keys() == {(r[2], r[3], r[4]) for r in rows}
    fitted = 0
    for league in (0, 1):
        own = pd.DataFrame([r for r in rows if r[3] // 20 == league], columns=[c.split()[0] for c in schema.split(", ")])
        for label, target in own.groupby("round"):
            first = target["match_date"].min()
            past = own[(own["match_date"] < first) & own["fthg"].notna()]
            weight = past["match_date"].map(lambda x: np.exp(-decay * (first - x).days))
            seen, result = set(past["home_id"]) | set(past["away_id"]), None
            sums = past.assign(n=weight, hg=weight * past["fthg"], ag=weight * past["ftag"], **{f"n{i}{j}": weight * ((past["fthg"] == i) & (past["ftag"] == j)) for i in (0, 1) for j in (0, 1)}).groupby(["home_id", "away_id"])[list(goal_model.COUNTS)].sum().reset_index()
            scored = {t: past[past["home_id"] == t]["fthg"].sum() + past[past["away_id"] == t]["ftag"].sum() for t in seen}
            conceded = {t: past[past["home_id"] == t]["ftag"].sum() + past[past["away_id"] == t]["fthg"].sum() for t in seen}
            status = "burn_in" if len(past) < 12 else "separated" if min(min(scored.values()), min(conceded.values())) == 0 else "fitted"
            if status == "fitted":
                names, attack, defence, level, edge, rho, *_ = goal_model.maximise(sums)
                result = {t: (attack[i], defence[i]) for i, t in enumerate(names)}
            for _, m in target.iterrows():
                r = got[label, m["home_id"], m["away_id"]]
                assert r["trained"] == len(past)
                if status != "fitted":
                    assert r["status"] == status and r["home"] is None
                elif m["home_id"] not in seen or m["away_id"] not in seen:
                    assert r["status"] == "unknown_team"
                else:
                    fitted += 1
                    assert r["status"] == "fitted" and r["home"] == pytest.approx(np.exp(level + edge + result[m["home_id"]][0] - result[m["away_id"]][1]), rel=1e-5)
                    assert r["away"] == pytest.approx(np.exp(level + result[m["away_id"]][0] - result[m["home_id"]][1]), rel=1e-5) and r["rho"] == pytest.approx(rho, abs=1e-5)
    assert fitted > 40 and {r["status"] for r in got.values()} >= {"burn_in", "fitted", "unknown_team"}


# --- boosted trees


def curved(seed, n=3000):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 3))
    rate = np.exp(0.2 + np.where((x[:, 0] > 0.3) & (x[:, 1] < 0), 1.0, -0.3))
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(n), goals=rng.poisson(rate).astype(float), valid=np.arange(n) % 4 == 3)
    frame.loc[rng.random(n) < 0.05, "b"] = np.nan
    return frame


def deviance(y, mu):
    return float(2 * (np.where(y > 0, y * np.log(np.maximum(y, 1) / mu), 0.0) - (y - mu)).mean())


def plain_trees(frame, features, edges, settings):
    """Margins of all rows by trees grown with every split tried on the rows themselves."""
    bins = boosting.binned(frame[list(features)].to_numpy(), edges)
    y, fit = frame["goals"].to_numpy(), ~frame["valid"].to_numpy()
    margin, kept, best, out, width = np.full(len(y), np.log(y[fit].mean())), 0, np.inf, [], settings.bins + 1

    def split(at):
        g, h = (y - np.exp(margin))[at & fit], np.exp(margin)[at & fit]
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + settings.ridge)
        found = (1e-9, 0, width - 1)
        for j in range(len(features)):
            for b in range(width):
                left = bins[at & fit, j] <= b
                if h[left].sum() >= settings.least and h[~left].sum() >= settings.least:
                    gain = score(left) + score(~left) - score(np.ones(len(g), bool))
                    if gain > found[0] + 1e-9:
                        found = (gain, j, b)
        return bins[:, found[1]] <= found[2]

    for _ in range(settings.trees):
        loss = deviance(y[~fit], np.exp(margin[~fit]))
        out.append(margin.copy())
        if loss < best - 1e-12:
            best, kept = loss, len(out) - 1
        if len(out) - 1 - kept >= settings.patience:
            break
        top = split(np.ones(len(y), bool))
        move = np.zeros(len(y))
        for half in (top, ~top):
            low = split(half)
            for leaf in (half & low, half & ~low):
                own = leaf & fit
                move[leaf] = settings.rate * (y - np.exp(margin))[own].sum() / (np.exp(margin)[own].sum() + settings.ridge)
        margin = margin + move
    return out[kept]


def test_trees_equal_plain_ones_and_beat_a_line(spark):
    frame, features, settings = curved(3), ("a", "b", "c"), boosting.Settings(trees=14, bins=8, rate=0.3, patience=3)
    rows = spark.createDataFrame(frame).withColumn("b", F.nullif("b", F.lit(float("nan")))).repartition(3)
    model = boosting.fit(rows, features, "goals", F.col("valid"), settings)
    got = boosting.rates(model, rows).orderBy("id").toPandas()["rate"].to_numpy()
    want = np.clip(np.exp(plain_trees(frame, features, model.edges, settings)), boosting.LEAST_RATE, boosting.MOST_RATE)
    assert np.allclose(got, want, rtol=1e-9)
    assert model.importance()["c"] < 0.05 and sum(model.importance().values()) == pytest.approx(1)
    line = folds.season_forecasts(rows.fillna(0.0, ["b"]).withColumn("fold", F.col("valid").cast("string")), Base(features, "goals", "poisson"), "fold").where("valid").orderBy("id").toPandas()["rate"]
    y = frame["goals"][frame["valid"]].to_numpy()
    assert deviance(y, got[frame["valid"]]) < deviance(y, line.to_numpy()) - 0.05


def test_trees_stop_on_the_validation_rows(spark):
    frame = curved(5, 400)
    frame["goals"] = np.random.default_rng(0).poisson(1.5, len(frame)).astype(float)  # nothing to learn
    model = boosting.fit(spark.createDataFrame(frame), ("a", "b", "c"), "goals", F.col("valid"), boosting.Settings(trees=40, rate=0.5, least=1.0, patience=3))
    losses = [v for _, v in model.deviances]
    assert len(model.trees) < 10 and len(model.deviances) <= len(model.trees) + 5 and losses[len(model.trees)] == min(losses)


def test_trees_without_rows(spark):
    rows = spark.createDataFrame(curved(1, 20)).limit(0)
    model = boosting.fit(rows, ("a",), "goals", F.lit(False))
    assert not model.trees and boosting.rates(model, rows).collect() == []


def test_form_is_made_once(spark, small):
    """Fits and forecasts read rows that were written, and shuffle nothing to have them again; they are those of the views."""
    rows = fitted.with_form(spark, small)
    assert all("/with_form-" in f for f in rows.inputFiles()) and "Exchange" not in fitted.sides(rows)._jdf.queryExecution().executedPlan().toString()
    m = {r["match_id"]: r for r in t.matches(spark, small).collect()}
    got = rows.collect()
    assert len(got) == len(m) and all((r["season"], r["fthg"], r["ftag"]) == (m[r["match_id"]]["season"], m[r["match_id"]]["fthg"], m[r["match_id"]]["ftag"]) for r in got)
