"""Queries on players and their appearances."""

from pyspark.sql import Window as W, functions as F

from fieldglass.operators import players as pl
from fieldglass.sources import tables as t

from .evaluation import SETTLED
from .registry import query


@query("f46_selling_price", "select player_id, (case when minutes%90>price then price+(minutes%90-price)//2 else minutes%90 end)::bigint sells from players")
def f46(s, d):
    return t.players(s, d).select("player_id", pl.selling_price(F.col("price"), F.col("minutes") % 90).alias("sells"))


@query("p11_chance_of_playing", """select player_id, case when status in ('u','n') then 0 when chance is not null then chance/100.0::double when status='a' then 1 when minutes>2000 then 1 when status='d' then 0.75::double when status in ('i','s') then 0.1::double else 0 end::double p from players""")
def p11(s, d):
    return t.players(s, d).select("player_id", pl.chance_of_playing(F.col("status"), F.col("chance"), F.col("minutes") > 2000).alias("p"))


@query("a8_a10_recency_rates", """with s as (select season, dense_rank() over (order by season) s from (select distinct season from appearances)), a as (select *, s*38+round at_ from appearances join s using (season)),
w as (select *, power(0.5::double,((select max(at_) from a)-at_)/38.0::double) w from a), g as (select player_id, position, sum(w*minutes) m, sum(w*goals) v from w group by 1,2), p as (select position, sum(v)/sum(m) prior from g group by 1)
select player_id, position, round(90*(v+450*prior)/(m+450),6) per_90, round(m/(m+450),6) evidence from g join p using (position)""")
def a10(s, d):
    return pl.recency_rates(t.appearances(s, d), "goals")


@query("a12_team_shares", """with r as (select *, greatest(0.01::double, 0.8::double*coalesce(goals/nullif(sum(goals) over (partition by team_id),0),0)+0.2::double/count(*) over (partition by team_id)) raw from players) select player_id, team_id, round(raw/sum(raw) over (partition by team_id),6) as share from r""")
def a12(s, d):
    return pl.team_shares(t.players(s, d), "goals")


@query("a13_m8_bookings", """with g as (select player_id, 90*sum(yellow+red)/sum(minutes)::double rate from appearances group by 1 having sum(minutes)>0) select player_id, round(rate,6) rate, round(least(0.95::double,1-exp(-rate)),6) chance, rate>=(select quantile_cont(rate,0.75) from g) as magnet from g""")
def a13(s, d):
    return pl.bookings(t.appearances(s, d))


@query("a14_negative_binomial", """with g as (select team_id, avg(minutes) mean, var_samp(minutes) var from appearances group by 1), n as (select *, power(mean,2)/(greatest(var,mean*1.01::double)-mean) n from g where mean>0) select team_id, round(mean,6) mean, round(n,4) n, round(n/(n+mean),6) p from n""")
def a14(s, d):
    return pl.negative_binomial(t.appearances(s, d), "team_id", "minutes")


@query("a15_zero_inflated", """with g as (select team_id, avg(yellow) mean, avg((yellow=0)::int) zeros from appearances group by 1), e as (select *, greatest(0,least(0.5::double,zeros-exp(-mean))) extra from g) select team_id, round(extra,6) zero_share, round(mean/(1-extra),6) rate from e""")
def a15(s, d):
    return pl.zero_inflated(t.appearances(s, d), "team_id", "yellow")


@query("a11_bonus_buckets", f"with {SETTLED} select position, least(goals,2) goals, least(assists,2) assists, count(*) n, round(avg(points),6) mean, round(stddev_pop(points),6) sd from scored group by 1,2,3")
def a11(s, d):
    return pl.bonus_buckets(t.appearances(s, d))


@query("a25_mode", f"with {SETTLED}, c as (select player_id, points, count(*) n from scored group by 1,2) select player_id, arg_max(points, n*100000-points)::bigint as usual from c group by 1")
def a25(s, d):
    return pl.scored(t.appearances(s, d)).groupBy("player_id").agg(F.mode("points", True).alias("usual"))


@query("a26_draw_summary", f"""with {SETTLED} select player_id, round(avg(points),6) mean, round(stddev_pop(points),6) sd, round(avg((points>=5)::int),6) p_ge_5, round(avg((points>=10)::int),6) p_ge_10, round(quantile_cont(points,0.1),6) q10, round(quantile_cont(points,0.5),6) q50, round(quantile_cont(points,0.9),6) q90, round(stddev_pop(points)/sqrt(count(*)),6) mc_se from scored group by 1""")
def a26(s, d):
    p, rows = F.col("points"), pl.scored(t.appearances(s, d))
    q = [F.round(F.percentile("points", F.lit(x / 100)), 6).alias(f"q{x}") for x in (10, 50, 90)]
    at = [F.round(F.avg((p >= k).cast("double")), 6).alias(f"p_ge_{k}") for k in (5, 10)]
    return rows.groupBy("player_id").agg(F.round(F.avg(p), 6).alias("mean"), F.round(F.stddev_pop(p), 6).alias("sd"), *at, *q, F.round(F.stddev_pop(p) / F.sqrt(F.count("*")), 6).alias("mc_se"))


@query("a29_ownership", "select player_id, round(least(1,selected_by/(sum(selected_by) over ()/15)),6) as share from players")
def a29(s, d):
    return pl.ownership(t.players(s, d))


@query("p18_universe", "select player_id from players where (status='a' and (chance is null or chance>=50)) or selected_by>=0.5")
def p18(s, d):
    return pl.universe(t.players(s, d)).select("player_id")


POOL = """reasons as (select *, case when selected_by>9.5 then null when status in ('u','n') then 'gone' when minutes<90 then 'minutes' when chance<25 then 'unlikely' when xp<=0 then 'no points' end reason from players)"""


def pool(s, d):
    p = t.players(s, d)
    return pl.pool(p, p.where("selected_by > 9.5").select("player_id"))


@query("p19_candidate_pool", f"with {POOL} select player_id, team_id, position, price, xp from reasons where reason is null")
def p19(s, d):
    return pool(s, d).where("reason is null").drop("reason")


@query("a24_drop_reasons", f"with {POOL} select reason, count(*) n from reasons where reason is not null group by 1")
def a24(s, d):
    return pool(s, d).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("t2_top_scorers", "select team_id, player_id, goals, rank from (select *, row_number() over (partition by team_id order by goals desc, minutes, player_id) as rank from players) where rank<=3")
def t2(s, d):
    return pl.top_in_group(t.players(s, d), ["team_id"], [F.desc("goals"), "minutes", "player_id"], 3).select("team_id", "player_id", "goals", F.col("rank").cast("long").alias("rank"))


@query("t4_notable", "select player_id, xp, goals from players order by goals desc, xp desc, player_id limit 60")
def t4(s, d):
    return t.players(s, d).orderBy(F.desc("goals"), F.desc("xp"), "player_id").limit(60).select("player_id", "xp", "goals")


@query("t7_candidates", """with v as (select *, row_number() over (partition by position order by xp desc, player_id) a, row_number() over (partition by position order by xp/price desc, player_id) b from players) select player_id, position from v where a<=22 or b<=14""")
def t7(s, d):
    return pl.candidates(t.players(s, d))


@query("o4_best_eleven", """with r as (select *, row_number() over (partition by team_id, position order by xp desc, player_id) n from players), c as (select team_id, position, n, sum(xp) over (partition by team_id, position order by n) s from r),
f as (select g.team_id, g.s+d.s+m.s+f.s as pts, (d.n||'-'||m.n||'-'||f.n) formation from c g join c d using (team_id) join c m using (team_id) join c f using (team_id) where g.position='GKP' and g.n=1 and d.position='DEF' and d.n between 3 and 5 and m.position='MID' and m.n between 2 and 5 and f.position='FWD' and f.n between 1 and 3 and d.n+m.n+f.n=10),
b as (select team_id, max(pts) pts, arg_max(formation, pts) formation from f group by 1), k as (select team_id, arg_max(player_id, xp) captain, max(xp) extra from players group by 1)
select team_id, formation, round(pts+extra,6) points, captain from b join k using (team_id)""")
def o4(s, d):
    return pl.best_eleven(t.players(s, d), "team_id")


def with_spread(s, d):
    return t.players(s, d).withColumn("sd", F.col("minutes") / 500.0)


@query("j18_best_twins", "with s as (select player_id, position, xp, minutes/500.0::double sd from players) select a.position, arg_max(a.player_id, struct_pack(g:=abs(a.sd-b.sd), a:=-a.player_id, b:=-b.player_id)) a, arg_max(b.player_id, struct_pack(g:=abs(a.sd-b.sd), a:=-a.player_id, b:=-b.player_id)) b, round(max(abs(a.sd-b.sd)),6) gap from s a join s b on a.position=b.position and a.player_id<b.player_id and abs(a.xp-b.xp)<=0.05 where abs(a.sd-b.sd)>=1.5 group by a.position")
def j18_best(s, d):
    return pl.best_twins(with_spread(s, d))


@query("j18_twins", "select a.position, a.player_id a, b.player_id b, round(abs(a.minutes/500.0::double-b.minutes/500.0::double),6) gap from players a join players b on a.position=b.position and a.player_id<b.player_id and abs(a.xp-b.xp)<=0.05 and abs(a.minutes/500.0::double-b.minutes/500.0::double)>=1.5")
def j18(s, d):
    return pl.twins(with_spread(s, d))


@query("j19_transfers", """with o as (select * from players qualify row_number() over (partition by team_id order by xp, player_id)<=2), h as (select team_id, count(*) held from o group by 1),
j as (select o.player_id out_id, i.player_id in_id, round(i.xp-o.xp,6) gain from o join (select p.*, coalesce(held,0) held from players p left join h using (team_id) where p.player_id not in (select player_id from o)) i on i.position=o.position and i.price<=o.price+5 and i.xp>o.xp and i.held-(i.team_id=o.team_id)::int<3),
r as (select *, row_number() over (partition by out_id order by gain desc, in_id) as rank from j) select * from r where rank<=3""")
def j19(s, d):
    p = t.players(s, d)
    owned = p.withColumn("n", F.row_number().over(W.partitionBy("team_id").orderBy("xp", "player_id"))).where("n <= 2").drop("n")
    return pl.transfers(owned, p, 5)
