"""Queries on forecasts and their outcomes."""

from pyspark.sql import functions as F

from fieldglass.operators import evaluation as ev, markets, players as pl
from fieldglass.sources import tables as t

from .markets import RATES, rates
from .registry import query

LOSS = "-(y*ln(greatest(least(p,1-1e-15::double),1e-15::double))+(1-y)*ln(1-greatest(least(p,1-1e-15::double),1e-15::double)))"


@query("e1_e2_proper_scores", f"select count(*) n, round(avg(power(p-y,2)),6) brier, round(avg({LOSS}),6) log_loss from forecasts")
def e1(s, d):
    return ev.proper_scores(t.forecasts(s, d))


@query("a20_round_means", f"select round, count(*) n, round(avg(power(p-y,2)),6) brier, round(avg({LOSS}),6) log_loss from forecasts group by round")
def a20(s, d):
    return ev.proper_scores(t.forecasts(s, d), ["round"])


@query("e3_ranked_score", f"""with {RATES}, w as (select match_id, sum(p) filter (i>j) h, sum(p) filter (i=j) d from grid group by 1)
select match_id, round((power(h-(fthg>ftag)::int,2)+power(h+d-(fthg>=ftag)::int,2))/2,6) rps from w join matches using (match_id) where fthg is not null""")
def e3(s, d):
    w = markets.exact_markets(rates(s, d)).join(t.matches(s, d).where("fthg is not null"), "match_id")
    outcome = F.when(F.col("fthg") > F.col("ftag"), 0).when(F.col("fthg") == F.col("ftag"), 1).otherwise(2)
    return w.select("match_id", F.round(ev.ranked_score([F.col("home_win"), F.col("draw"), F.col("away_win")], outcome), 6).alias("rps"))


@query("e4_calibration_error", "with b as (select least(floor(p*10),9) bin, count(*) n, abs(avg(p)-avg(y)) gap from forecasts group by 1) select round(sum(n*gap)/sum(n),6) ece, round(max(gap),6) worst from b")
def e4(s, d):
    return ev.calibration_error(t.forecasts(s, d))


@query("e5_calibration_curve", "select least(floor(p*10),9)::bigint bin, count(*) n, round(avg(p),6) predicted, round(avg(y),6) actual from forecasts group by 1")
def e5(s, d):
    return ev.calibration(t.forecasts(s, d))


@query("e7_scoreline_loss", f"with {RATES} select match_id, round(-ln(greatest(p,1e-15::double)),6) loss from matches m join grid using (match_id) where fthg is not null and i=least(fthg,7) and j=least(ftag,7)")
def e7(s, d):
    return ev.scoreline_loss(rates(s, d), t.matches(s, d))


@query("e8_crps", f"""with {RATES}, c as (select match_id, k, sum(p) over (partition by match_id order by k) c from (select match_id, i+j k, sum(p) p from grid group by 1,2))
select match_id, round(sum(power(c-(fthg+ftag<=k)::int,2)),6) crps from c join matches using (match_id) where fthg is not null group by 1""")
def e8(s, d):
    played = t.matches(s, d).where("fthg is not null").select("match_id", (F.col("fthg") + F.col("ftag")).alias("total_goals"))
    return ev.discrete_crps(markets.grid(rates(s, d)), played)


def settled(s, d):
    """Points against a plain forecast of them, by position and season."""
    rows = pl.scored(t.appearances(s, d))
    return rows.select("player_id", "row_id", "position", "season", F.col("points").alias("actual"), ((F.col("player_id") * 7 + F.col("season")) % 9 + 0.5).alias("predicted"))


SETTLED = """pts as (select *, case when red>0 then -3*red else -yellow end cards from appearances),
scored as (select *, case when minutes>0 then case when minutes>=60 then 2 else 1 end + goals*case position when 'GKP' then 10 when 'DEF' then 6 when 'MID' then 5 else 4 end + 3*assists
 + case when minutes>=60 and conceded=0 then case position when 'GKP' then 4 when 'DEF' then 4 when 'MID' then 1 else 0 end else 0 end
 + case when position in ('GKP','DEF') then -(conceded//2) else 0 end + case when position='GKP' then saves//3 else 0 end
 + case when (position='DEF' and actions>=10) or (position in ('MID','FWD') and actions>=12) then 2 else 0 end + cards else cards end as points from pts),
settled as (select player_id, row_id, position, season, points actual, (player_id*7+season)%9+0.5::double predicted from scored)"""


@query("f47_points", f"with {SETTLED} select row_id, points::bigint points from scored")
def f47(s, d):
    return pl.scored(t.appearances(s, d)).select("row_id", "points")


@query("a23_e10_errors", f"""with {SETTLED}, g as (select case when grouping(position)=0 then 'position' when grouping(season)=0 then 'season' else 'all' end as grouping, coalesce(position, season::varchar, 'all') as value, count(*) n, round(sqrt(avg(power(predicted-actual,2))),6) rmse, round(avg(predicted-actual),6) bias, round(avg(abs(predicted-actual)),6) mae
from settled group by grouping sets ((), (position), (season))) select * from g""")
def a23(s, d):
    return ev.errors(settled(s, d), ["position", "season"])


@query("e11_coverage", f"""with {SETTLED}, q as (select actual, unnest(['low','high']) as quantile, unnest([predicted-2,predicted+2]) at_ from settled) select quantile, round(avg((actual<=at_)::int),6) as closed, round(avg((actual<at_)::int),6) as open from q group by 1""")
def e11(s, d):
    rows = settled(s, d).select("actual", (F.col("predicted") - 2).alias("low"), (F.col("predicted") + 2).alias("high"))
    return ev.coverage(rows, ["low", "high"])


@query("e11_tails", f"""with {SETTLED}, q as (select actual, unnest([2,5,10]) as at_, unnest([predicted/10,predicted/20,predicted/40]) p from settled) select at_ as at, round(avg(p),6) predicted, round(avg((actual>=at_)::int),6) actual from q group by 1""")
def e11b(s, d):
    rows = settled(s, d).select("actual", *[(F.col("predicted") / k).alias(f"p_ge_{n}") for n, k in ((2, 10), (5, 20), (10, 40))])
    return ev.tail_reliability(rows, [2, 5, 10])


@query("e12_correlations", f"""with {SETTLED}, r as (select season, predicted, actual, rank() over (partition by season order by predicted)+(count(*) over (partition by season, predicted)-1)/2.0::double a, rank() over (partition by season order by actual)+(count(*) over (partition by season, actual)-1)/2.0::double b from settled)
select season, count(*) n, round(corr(predicted,actual),6) pearson, round(corr(a,b),6) spearman from r group by season""")
def e12(s, d):
    return ev.correlations(settled(s, d), "predicted", "actual", ["season"])


@query("e12_top_overlap", f"""with {SETTLED}, r as (select season, row_number() over (partition by season order by predicted desc, row_id) a, row_number() over (partition by season order by actual desc, row_id) b from settled) select season, count(*) filter (a<=100 and b<=100) as shared from r group by season""")
def e12b(s, d):
    return ev.top_overlap(settled(s, d), "predicted", "actual", "row_id", 100, ["season"])


@query("e13_e17_paired", f"""with {SETTLED}, m as (select player_id, avg(abs(predicted-actual)-abs(3-actual)) d from settled group by 1), a as (select count(*) n, avg(d) mean, stddev_samp(d) sd from m)
select n, round(mean,6) mean, round(sd/sqrt(n),6) se, round(mean/(sd/sqrt(n)),6) t, abs(mean)>sd*sqrt(2*(n*0.01::double+1)/(n*n*0.01::double)*ln(sqrt(n*0.01::double+1)/0.05::double)) as decisive from a""")
def e17(s, d):
    rows = settled(s, d).select("player_id", F.abs(F.lit(3) - F.col("actual")).alias("a"), F.abs(F.col("predicted") - F.col("actual")).alias("b"))
    return ev.paired(rows, "player_id", "a", "b")


@query("a21_intraclass", f"""with {SETTLED}, m as (select avg(actual) m from settled), g as (select count(*) n, avg(actual) g, sum(actual*actual) sq from settled group by player_id)
select round(sum(n*power(g-m,2))/(sum(sq)-sum(n)*power(any_value(m),2)),6) icc from g, m""")
def a21(s, d):
    return ev.intraclass(settled(s, d).withColumn("actual", F.col("actual").cast("double")), "player_id", "actual")


@query("e14_blend_search", f"""with b as (select w, round, avg({LOSS.replace("least(p,", "least(w*p+(1-w)*0.5::double,")}) loss from forecasts, (select unnest([0.0,0.25,0.5,0.75,1.0])::double w) group by 1,2), m as (select w, avg(loss) loss from b group by 1)
select w, round(loss,6) loss, w=(select arg_min(w, loss) from m) as best from m""")
def e14(s, d):
    return ev.blend_search(t.forecasts(s, d).withColumn("q", F.lit(0.5)), [0.0, 0.25, 0.5, 0.75, 1.0], "round")


@query("e10_against_perfect", "select count(*) n, round(sqrt(avg((p-y)*(p-y))),6) as rmse, round(avg(p-y),6) as bias, round(sqrt(avg(p*(1-p))),6) as perfect from forecasts")
def e10_perfect(s, d):
    out = ev.against_perfect(t.forecasts(s, d), "p", F.col("p") * (1 - F.col("p")), "y")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "bias", "perfect")])


@query("e7_likelihoods", f"""with {RATES}, w as (select match_id, sum(p) filter (i>j) h, sum(p) filter (i=j) d, sum(p) filter (i<j) a, sum(p) filter (j=0) hs_, sum(p) filter (i=0) as_ from grid group by 1), k as (select w.*, fthg, ftag from w join matches using (match_id) where fthg is not null)
select count(*) n, round(avg(-ln(case when fthg>ftag then h when fthg=ftag then d else a end)),6) as outcome, round(avg(-ln(case when ftag=0 then hs_ else 1-hs_ end)),6) as home_sheet, round(avg(-ln(case when fthg=0 then as_ else 1-as_ end)),6) as away_sheet from k""")
def e7_likelihoods(s, d):
    out = ev.likelihoods(markets.exact_markets(rates(s, d)), t.matches(s, d))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("outcome", "home_sheet", "away_sheet")])
