"""Queries on minutes, market-implied rates, calibrations and blends."""

from pyspark.sql import functions as F

from fieldglass.operators import rates_model as rm
from fieldglass.sources import tables as t

from .backtest import BOOK, book_forecasts
from .ledger import FREE, w17
from .markets import RATES, rates
from .registry import query


@query("f42_horizon_factors", "select match_id, round(0.4+0.6*power(0.9::double,k),6) factor, round(0.5*(1-power(0.8::double,k)),6) revert, round(case when k<3 then 0 else least(1,0.3+0.7*(k-3)/28.0::double) end,6) ramp from (select match_id, match_id%40 k from matches)")
def f42(s, d):
    k = F.col("match_id") % 40
    return t.matches(s, d).select("match_id", F.round(rm.horizon_factor(k), 6).alias("factor"), F.round(rm.reversion(k), 6).alias("revert"), F.round(rm.return_ramp(k - 3), 6).alias("ramp"))


@query("f49_saved_transfers", FREE + " select team_id, w as season, ([0.0::double,1.75,3.1,4.1,4.7,5.0])[free+1] as worth from f")
def f49(s, d):
    """What each club's free transfers are worth in each season if it saves them."""
    return w17(s, d).select("team_id", "season", F.round(rm.saved_value(F.col("free")), 6).alias("worth"))


@query("m9_roles", """with k as (select player_id, position, count(*) filter (minutes>=85) f, count(*) filter (minutes>=45 and minutes<85) p, count(*) filter (minutes>0 and minutes<45) o, count(*) filter (minutes<=0) u, count(*) n from appearances group by 1,2), b as (select position, sum(f)/sum(n) bf, sum(p)/sum(n) bp, sum(o)/sum(n) bo, sum(u)/sum(n) bu from k group by 1)
select player_id, position, round((f+4*bf)/(n+4),6) p_full, round((p+4*bp)/(n+4),6) p_part, round((o+4*bo)/(n+4),6) p_on, round((u+4*bu)/(n+4),6) p_out, round(n/(n+4),6) evidence from k join b using (position)""")
def m9(s, d):
    return rm.roles(t.appearances(s, d), "player_id")


def market(s, d):
    """Rates that a market might imply, from the shots, for matches with enough of them."""
    return t.matches(s, d).where("hs > 50").select("match_id", (1.0 + F.col("hs") % 13 / 10.0).alias("home"), (0.7 + F.col("away_s") % 11 / 10.0).alias("away"))


LEVEL = f"{RATES}, mk as (select match_id, 1.0::double+hs%13/10.0::double mh, 0.7::double+away_s%11/10.0::double ma from matches where hs>50), lv as (select count(*) n, greatest(-0.2, least(0.2, sum(ln(mh/home))/(count(*)+20))) l from rates join mk using (match_id))"


@query("f43_level_correction", f"with {LEVEL} select n, round(l,6) as level from lv")
def f43(s, d):
    both = rates(s, d).join(market(s, d).withColumnRenamed("home", "market_home"), "match_id")
    return rm.level_correction(both, "home", "market_home").withColumn("level", F.round("level", 6))


@query("m16_anchored_rates", f"""with {LEVEL}, j as (select r.match_id, mt.home_id, r.home, r.away, mh, ma, l, ln(r.home)+l bh, ln(r.away)+l ba, (r.home+r.away)/2 mean from rates r join matches mt using (match_id) left join mk using (match_id), lv),
k as (select *, case when mh is not null then exp(bh+greatest(-0.5,least(0.5,0.5*(ln(mh)-bh)))) else home end h, case when ma is not null then exp(ba+greatest(-0.5,least(0.5,0.5*(ln(ma)-ba)))) else away end a from j)
select match_id, round(case when home_id%20<3 then greatest(h,0.9*mean) else h end,6) home, round(a,6) away, case when mh is not null then 'market' else 'model' end as source from k""")
def m16(s, d):
    own = rates(s, d).join(t.matches(s, d).select("match_id", (F.col("home_id") % 20 < 3).alias("home_promoted")), "match_id").withColumn("away_promoted", F.lit(False))
    level = rm.level_correction(own.join(market(s, d).withColumnRenamed("home", "market_home").drop("away"), "match_id"), "home", "market_home")
    out = rm.anchored(own, market(s, d), level)
    return out.select("match_id", F.round("home", 6).alias("home"), F.round("away", 6).alias("away"), "source")


@query("j21_preferred_rates", "select match_id, case when hs>80 then hs/100.0::double when away_s>60 then away_s/100.0::double else 1.35 end as rate, case when hs>80 then 'exported' when away_s>60 then 'fitted' else 'flat' end as source from matches")
def j21(s, d):
    m = t.matches(s, d)
    exported = m.where("hs > 80").select("match_id", (F.col("hs") / 100.0).alias("rate"))
    fitted = m.select("match_id", F.when(F.col("away_s") > 60, F.col("away_s") / 100.0).alias("rate"))
    return rm.preferred(exported, fitted, 1.35, "match_id")


@query("m14_d3_blended_rates", "select match_id, round((0.6::double*hs/50.0::double+case when fthg is not null and hy>0 then 0.3::double*fthg else 0 end+case when ay>0 then 0.1::double*ftag else 0 end)/(0.6::double+case when hy>0 then 0.3::double else 0 end+case when ay>0 then 0.1::double else 0 end),6) as rate from matches where hs is not null")
def m14(s, d):
    rows = t.matches(s, d).where("hs is not null").select("match_id", (F.col("hs") / 50.0).alias("a"), F.when(F.col("hy") > 0, F.col("fthg").cast("double")).alias("b"), F.when(F.col("ay") > 0, F.col("ftag").cast("double")).alias("c"))
    return rows.select("match_id", F.round(rm.blend(rows, {"a": 0.6, "b": 0.3, "c": 0.1}), 6).alias("rate"))


@query("m12_platt")
def m12(s, d):
    return rm.platt(t.forecasts(s, d)).select("key", F.round("calibrated", 5).alias("calibrated"))


@query("m12_isotonic")
def m12_isotonic(s, d):
    return rm.isotonic(t.forecasts(s, d)).select("key", F.round("calibrated", 6).alias("calibrated"))


def labelled(s, d):
    m = t.matches(s, d).where("fthg is not null")
    return book_forecasts(s, d).join(m.select("match_id", F.when(F.col("fthg") > F.col("ftag"), 0).when(F.col("fthg") == F.col("ftag"), 1).otherwise(2).alias("y"), "fthg", "home_id", "away_id"), "match_id")


@query("m5_goal_regression")
def m5(s, d):
    return rm.goal_regression(labelled(s, d), ["p_h", "p_a"], "fthg").select("match_id", F.round("rate", 5).alias("rate"))


@query("t12_importance", f"with {BOOK}, j as (select p_h, p_d, p_a, fthg from f join matches using (match_id) where fthg is not null) select feature, round(weight,6) as weight from (select corr(p_h, fthg) p_h, corr(p_d, fthg) p_d, corr(p_a, fthg) p_a from j) unpivot (weight for feature in (p_h, p_d, p_a))")
def t12(s, d):
    return rm.importance(labelled(s, d), ["p_h", "p_d", "p_a"], "fthg").withColumn("weight", F.round("weight", 6))


@query("m8_m10_anytime_scorers", """with s as (select player_id, team_id, goals/sum(goals) over (partition by team_id) as share, least(90,minutes%91) em from players), r as (select home_id team_id, avg(fthg) rate from matches group by 1) select player_id, round(1-exp(-share*rate*em/90),6) as anytime from s join r using (team_id)""")
def m8(s, d):
    from pyspark.sql import Window as W

    shares = t.players(s, d).select("player_id", "team_id", (F.col("goals") / F.sum("goals").over(W.partitionBy("team_id"))).alias("share"), (F.col("minutes") % 91).alias("expected_minutes"))
    scoring = t.matches(s, d).groupBy(F.col("home_id").alias("team_id")).agg(F.avg("fthg").alias("rate"))
    return rm.player_events(shares, scoring, "team_id").select("player_id", F.round("anytime", 6).alias("anytime"))


@query("m6_m7_recent_factors", """with r as (select match_id, team, shots, row_number() over w n, avg(shots) over (partition by team order by match_date, match_id rows between 10 preceding and 1 preceding) l, avg(shots) over (partition by team order by match_date, match_id rows between unbounded preceding and 1 preceding) e, count(shots) over (partition by team order by match_date, match_id rows between unbounded preceding and 1 preceding) c from team_rows window w as (partition by team order by match_date, match_id))
select match_id, team, round(case when c>=5 and e>0 then greatest(0.6,least(1.5,l/e)) else 1 end,6) as factor from r""")
def m6(s, d):
    rows = t.team_rows(t.matches(s, d)).withColumn("at", F.struct("match_date", "match_id"))
    return rm.counts_fit(rows, "team", "shots", "at").select("match_id", "team", F.round("factor", 6).alias("factor"))
