"""Queries on simulated matches and fitted strengths."""

from pyspark.sql import functions as F

from fieldglass.operators import goal_model, simulation
from fieldglass.sources import tables as t

from .markets import RATES, rates
from .registry import query

#: Draws of each match.
DRAWS = 50
QUERIES_OF_DRAWS = ("x5_a27_simulated_markets", "x2_half_time_scores", "x10_round_points")
DRAWN = f"""{RATES}, cum as (select match_id, i, j, sum(p) over (partition by match_id order by i, j) hi, count(*) over (partition by match_id order by i, j) n, p from grid),
u as (select match_id, draw, ('0x'||substr(md5(match_id||':'||draw||':score'),1,13))::bigint/4503599627370496.0::double u from rates, range({DRAWS}) d(draw)),
band as (select match_id, i, j, coalesce(lag(hi) over (partition by match_id order by i, j),0) lo, case when n=64 then 2 else hi end hi from cum),
drawn as (select u.match_id, draw, i, j from u join band on u.match_id=band.match_id and u.u>=lo and u.u<hi)"""
SHARE = lambda c: f"round(avg(case when {c} then 1.0::double else 0 end),6)"


@query("x5_a27_simulated_markets", f"with {DRAWN} select match_id, count(*) draws, {SHARE('i>j')} home_win, {SHARE('i=j')} draw_share, {SHARE('i<j')} away_win, {SHARE('i+j>2')} over_2_5, {SHARE('i>0 and j>0')} btts, {SHARE('j=0')} home_clean_sheet from drawn group by match_id")
def x5(s, d):
    return simulation.market_shares(simulation.scores(simulation.spread(rates(s, d), "match_id"), DRAWS))


def _early(goals, side):
    return f"(select count(*) from range(1,8) g(k) where k<={goals} and ('0x'||substr(md5(match_id||':'||draw||':{side}:'||k),1,13))::bigint/4503599627370496.0::double<0.45::double)"


@query("x2_half_time_scores", f"with {DRAWN}, h as (select *, {_early('i', 'home')} hi, {_early('j', 'away')} hj from drawn) select match_id, sum(hi)::bigint half_home, sum(hj)::bigint half_away, {SHARE('hi>hj and i<=j')} lead_lost from h group by match_id")
def x2(s, d):
    rows = simulation.half_time(simulation.scores(simulation.spread(rates(s, d), "match_id"), DRAWS))
    lost = (F.col("half_i") > F.col("half_j")) & (F.col("i") <= F.col("j"))
    return rows.groupBy("match_id").agg(F.sum("half_i").alias("half_home"), F.sum("half_j").alias("half_away"), F.round(F.avg(lost.cast("double")), 6).alias("lead_lost"))


@query("x10_round_points", f"""with {DRAWN}, b as (select drawn.*, season*100+week(match_date) as round, home_id, away_id from drawn join matches using (match_id)),
s as (select round, draw, home_id team, case when i>j then 3 when i=j then 1 else 0 end pts from b union all select round, draw, away_id, case when j>i then 3 when i=j then 1 else 0 end from b),
p as (select round, team, draw, sum(pts)::bigint points, count(*) matches from s group by 1,2,3)
select round::int round, team, max(matches) matches, round(avg(points),6) mean, round(stddev_pop(points),6) sd, {SHARE('points>=3')} p_ge_3, round(quantile_cont(points,0.9),6) q90 from p group by 1,2""")
def x10(s, d):
    fixtures = t.matches(s, d).select("match_id", (F.col("season") * 100 + F.weekofyear("match_date")).alias("round"), "home_id", "away_id")
    return simulation.simulated_rounds(rates(s, d), fixtures, DRAWS)


@query("m2_pair_scores", "select season, home_id, away_id, count(*)::double n, sum(fthg)::double hg, sum(ftag)::double ag, sum((fthg=0 and ftag=0)::int)::double n00, sum((fthg=0 and ftag=1)::int)::double n01, sum((fthg=1 and ftag=0)::int)::double n10, sum((fthg=1 and ftag=1)::int)::double n11 from matches where fthg is not null group by 1,2,3")
def m2_pairs(s, d):
    return goal_model.pair_scores(t.matches(s, d), "season")


@query("m2_fitted_strengths")
def m2(s, d):
    values = ("attack", "defence", "level", "home_edge", "rho")
    return goal_model.fit(t.matches(s, d)).select("season", "team", *[F.round(v, 4).alias(v) for v in values], "status")
