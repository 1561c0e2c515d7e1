"""Queries on models that never see what they forecast: seasons left out, rounds walked forward, trees stopped on a later season.

Fits are beyond SQL; tests hold them against plain versions.
"""

from pyspark.sql import functions as F

from fieldglass.operators import boosting, features as ft, folds, logs, walking
from fieldglass.operators.folds import Base
from fieldglass.sources import tables as t
from fieldglass.sources.scratch import stored

from .registry import query

FORM = tuple(f"{side}_{c}" for side in ("home", "away") for c in ("gf_ewm5", "ga_ewm5", "shots_ewm10", "rest"))
MARKET = ("log_home", "log_away")


def with_form(s, d):
    """Matches with both sides' form before them, the books' mean log odds, and the outcome (0 home, 1 draw, 2 away).

    What fits look at, written once: fits and forecasts read it several times, and each time would sort and shuffle all team rows again.
    """
    m = stored(t.matches(s, d), "matches")
    rows = t.team_rows(m)
    known = ft.ewm_features(rows, ("gf", "ga", "shots"), (5, 10)).join(ft.rest_days(rows), ["match_id", "team"])
    known = rows.select("match_id", "team", "is_home").join(known, ["match_id", "team"])
    pick = lambda c, home: F.max(F.when(F.col("is_home") == home, F.col(c)))
    form = known.groupBy("match_id").agg(*[pick(c, side == "home").alias(f"{side}_{c}") for side in ("home", "away") for c in ("gf_ewm5", "ga_ewm5", "shots_ewm10", "rest")])
    inverse = lambda o: F.avg(F.when(F.col("outcome") == o, 1 / F.col("price")))
    market = t.prices(m).groupBy("match_id").agg(F.log(inverse("H") / inverse("D")).alias("log_home"), F.log(inverse("A") / inverse("D")).alias("log_away"))
    y = F.when(F.col("fthg") > F.col("ftag"), 0).when(F.col("fthg") == F.col("ftag"), 1).when(F.col("fthg") < F.col("ftag"), 2)
    return stored(m.join(form, "match_id").join(market, "match_id").select("match_id", "season", "fthg", "ftag", *FORM, *MARKET, y.alias("y")), "with_form")


def sides(rows):
    """Two rows a match, each with its own side's goals: the trees' view."""
    out = None
    for me, you, goals, home in (("home", "away", "fthg", 1.0), ("away", "home", "ftag", 0.0)):
        one = rows.select("match_id", "season", F.lit(home).alias("at_home"), F.col(goals).alias("goals"), *[F.col(f"{who}_{c}").alias(f"{as_}_{c}") for who, as_ in ((me, "own"), (you, "other")) for c in ("gf_ewm5", "ga_ewm5", "shots_ewm10", "rest")], (F.col(f"log_{me}") - F.col(f"log_{you}")).alias("odds"))
        out = one if out is None else out.unionByName(one)
    return out


SIDE = ("at_home", "odds", *[f"{who}_{c}" for who in ("own", "other") for c in ("gf_ewm5", "ga_ewm5", "shots_ewm10", "rest")])


@query("e15_season_models")
def e15_season_models(s, d):
    """Home goals of each season by a Poisson regression on the other seasons."""
    out = folds.season_forecasts(with_form(s, d), Base(FORM, "fthg", "poisson"), "season")
    return out.select("match_id", "season", F.round("rate", 5).alias("rate"))


@query("m13_stacked")
def m13_stacked(s, d):
    """Outcomes by a second model on goals and outcomes models, all of them without the match's season."""
    bases = [Base(FORM, "fthg", "poisson"), Base(FORM, "ftag", "poisson"), Base(MARKET, "y", "multinomial")]
    out = folds.stacked(with_form(s, d), bases, "y", "season")
    return out.select("match_id", "season", *[F.round(f"p_{k}", 5).alias(f"p_{k}") for k in range(folds.CLASSES)])


def goal_trees(s, d):
    rows = sides(with_form(s, d))
    last = rows.agg(F.max("season")).first()[0]
    return rows, boosting.fit(rows, SIDE, "goals", F.col("season") == last, boosting.Settings(trees=30))


@query("m5_boosted_goals")
def m5_boosted_goals(s, d):
    """Both sides' goals by trees that stop on the last season."""
    rows, model = goal_trees(s, d)
    return boosting.rates(model, rows).select("match_id", (F.col("at_home") == 1).alias("home"), F.round("rate", 5).alias("rate"))


@query("t12_gain_importance")
def t12_gain_importance(s, d):
    """Features by their share of the gain of the trees' splits."""
    _, model = goal_trees(s, d)
    return s.createDataFrame(list(model.importance().items()), "feature string, share double").select("feature", F.round("share", 5).alias("share")).orderBy(F.desc("share"), "feature")


@query("e16_refitted")
def e16_refitted(s, d):
    """Each league's rounds by strengths refitted before them; a round is a calendar week of a season."""
    m = t.matches(s, d)
    out = walking.walk_forward(m, F.expr("home_id div 20"), logs.iso_week(F.col("season"), F.col("match_date")), least=60)
    return out.select("league", "round", "home_id", "away_id", F.round("trained", 6).alias("trained"), *[F.round(c, 5).alias(c) for c in ("home", "away", "rho")], "status")
