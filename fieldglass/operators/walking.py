"""Strengths refitted before every round, from sums that are carried along instead of from all earlier rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .goal_model import COUNTS, maximise

OUT = "home_id int, away_id int, trained double, home double, away double, rho double, status string"


def day_sums(matches: DataFrame, league: Column, round_: Column) -> DataFrame:
    """(league, round, day, home_id, away_id, COUNTS): what a fit needs of a day's matches between two teams; unplayed ones count nothing."""
    h, a = F.col("fthg"), F.col("ftag")
    played = h.isNotNull() & a.isNotNull()
    low = {f"n{i}{j}": F.count_if((h == i) & (a == j)) for i in (0, 1) for j in (0, 1)}
    sums = {"n": F.count_if(played), "hg": F.coalesce(F.sum(F.when(played, h)), F.lit(0)), "ag": F.coalesce(F.sum(F.when(played, a)), F.lit(0)), **low}
    keys = {"league": league, "round": round_, "day": F.datediff("match_date", F.lit("1970-01-01")), "home_id": F.col("home_id"), "away_id": F.col("away_id")}
    return matches.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*[sums[c].cast("double").alias(c) for c in COUNTS])


def carried(days: pd.DataFrame, decay: float, least: float) -> Iterator[tuple]:
    """(round, home_id, away_id, trained, home, away, rho, status) of a league's pairs by round: each round is forecast
    from the sums of the days before its first, which are weighted down by `decay` a day as they are carried on."""
    teams = sorted(set(days["home_id"]) | set(days["away_id"]))
    place = {t: i for i, t in enumerate(teams)}
    order = days.groupby("round")["day"].min().sort_values(kind="stable")
    days = days.sort_values("day", kind="stable")
    held, at, taken, matches = np.zeros((len(teams), len(teams), len(COUNTS))), None, 0, 0.0
    when, home, away = days["day"].to_numpy(), days["home_id"].map(place).to_numpy(), days["away_id"].map(place).to_numpy()
    counts = days[list(COUNTS)].to_numpy()
    for label, first in order.items():
        if at is not None:
            held *= np.exp(-decay * (first - at))
        new = slice(taken, taken := int(np.searchsorted(when, first)))
        np.add.at(held, (home[new], away[new]), counts[new] * np.exp(-decay * (first - when[new]))[:, None])
        matches, at = matches + counts[new, COUNTS.index("n")].sum(), first
        asked = days[days["round"] == label][["home_id", "away_id"]].drop_duplicates()
        status, found = ("burn_in", None) if matches < least else refit(held, teams)
        for h, a in asked.itertuples(index=False):
            if found is None:
                yield label, h, a, matches, None, None, None, status
            elif h not in found[0] or a not in found[0]:
                yield label, h, a, matches, None, None, None, "unknown_team"
            else:
                known, attack, defence, level, edge, rho = found
                yield label, h, a, matches, float(np.exp(level + edge + attack[known[h]] - defence[known[a]])), float(np.exp(level + attack[known[a]] - defence[known[h]])), rho, "fitted"


def refit(held: np.ndarray, teams: list[int]):
    """(status, (places, attack, defence, level, edge, rho)) from sums by pair; a team that never scored or never conceded leaves no finite fit."""
    n, hg, ag = (held[..., COUNTS.index(c)] for c in ("n", "hg", "ag"))
    met = n.sum(1) + n.sum(0) > 0
    scored, conceded = hg.sum(1) + ag.sum(0), ag.sum(1) + hg.sum(0)
    if not ((scored > 0) & (conceded > 0))[met].all():
        return "separated", None
    home, away = np.nonzero(n)
    pairs = pd.DataFrame(held[home, away], columns=list(COUNTS)).assign(home_id=[teams[i] for i in home], away_id=[teams[i] for i in away])
    known, attack, defence, level, edge, rho, *_ = maximise(pairs)
    return "fitted", ({t: i for i, t in enumerate(known)}, attack, defence, level, edge, rho)


def walk_forward(matches: DataFrame, league: Column, round_: Column, decay: float = 0.0019, least: int = 100) -> DataFrame:
    """league, round, home_id, away_id, trained, home, away, rho, status: each round's rates from a fit of all matches before its first day.

    Spark sums the matches to days and pairs of teams; a league's sums (one group: its pairs by day, however many rows
    they came from) are then walked through once. A cutoff costs the new days and a fit on at most teams squared
    sums, so nothing joins rows with rounds. Statuses: burn_in (under `least` matches before), separated, unknown_team
    (not met before), fitted. A league or round that is null is one of its own; unplayed matches are forecast and teach nothing.
    """
    days = day_sums(matches, league, round_)
    kinds = {c: days.schema[c].dataType.simpleString() for c in ("league", "round")}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        label = frame["round"].astype(object).where(frame["round"].notna(), None)
        rows = list(carried(frame.assign(round=label.map(lambda v: ("", v) if v is not None else ("null", ""))), decay, least))
        out = pd.DataFrame(rows, columns=["round", *[c.split()[0] for c in OUT.split(", ")]])
        out["round"] = out["round"].map(lambda v: None if v[0] else v[1])
        return out.assign(league=frame["league"].iloc[0])[["league", *out.columns]]

    return days.groupBy("league").applyInPandas(run, f"league {kinds['league']}, round {kinds['round']}, {OUT}")
