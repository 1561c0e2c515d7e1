"""Queries that hold forecasts against outcomes."""

from pyspark.sql import functions as F

from fieldglass.operators import backtest as bt, players as pl
from fieldglass.sources import tables as t

from .evaluation import SETTLED
from .registry import query

LOSS = "-(y*ln(greatest(least({p},1-1e-15::double),1e-15::double))+(1-y)*ln(1-greatest(least({p},1-1e-15::double),1e-15::double)))"
BOOK = "b as (select match_id, avg(1/price) filter (outcome='H') h, avg(1/price) filter (outcome='D') dr, avg(1/price) filter (outcome='A') a from prices group by 1), f as (select match_id, h/(h+dr+a) p_h, dr/(h+dr+a) p_d, a/(h+dr+a) p_a from b)"


def book_forecasts(s, d):
    share = F.col("H") + F.col("D") + F.col("A")
    wide = t.prices(t.matches(s, d)).groupBy("match_id").agg(*[F.avg(F.when(F.col("outcome") == o, 1 / F.col("price"))).alias(o) for o in "HDA"])
    return wide.select("match_id", *[(F.col(o) / share).alias(f"p_{o.lower()}") for o in "HDA"])


@query("e6_j5_evaluation", f"""with {BOOK}, j as (select *, case when fthg>ftag then 0 when fthg=ftag then 1 else 2 end y from f join matches using (match_id) where fthg is not null)
select count(*) n, round(avg(power(p_h-(y=0)::int,2)+power(p_d-(y=1)::int,2)+power(p_a-(y=2)::int,2)),6) brier, round(avg(-ln(case y when 0 then p_h when 1 then p_d else p_a end)),6) log_loss,
round(avg((power(p_h-(y=0)::int,2)+power(p_h+p_d-(y<=1)::int,2))/2),6) rps, round(avg((case when p_h>=p_d and p_h>=p_a then 0 when p_d>=p_a then 1 else 2 end=y)::int::double),6) accuracy from j""")
def e6(s, d):
    return bt.evaluate(book_forecasts(s, d), t.matches(s, d))


def settled(s, d):
    rows = pl.scored(t.appearances(s, d))
    return rows.select("player_id", "row_id", "position", "season", "minutes", F.col("points").alias("actual"), ((F.col("player_id") * 7 + F.col("season")) % 9 + 0.5).alias("predicted"))


@query("e9_band_errors", f"""with {SETTLED}, r as (select *, abs(predicted-actual) o from settled join (select row_id, minutes from appearances) using (row_id)) select round(avg(o),6) mae_all, round(avg(o) filter (actual=0),6) mae_zero, round(avg(o) filter (actual in (1,2)),6) mae_ones, round(avg(o) filter (minutes>0),6) mae_played,
count(*) n_all, count(*) filter (actual=0) n_zero, count(*) filter (actual in (1,2)) n_ones, count(*) filter (minutes>0) n_played from r""")
def e9(s, d):
    return bt.band_errors(settled(s, d))


def two_forecasts(s, d):
    return t.forecasts(s, d).withColumn("q", (F.col("key") * 31 % 997) / 997.0).withColumn("fold", F.col("round") % 4)


@query("e14_m17_blend_folds", f"""with w as (select round%4 fold, i/10.0::double weight, count(*) n, sum({LOSS.format(p="(i/10.0::double*p+(1-i/10.0::double)*((key*31%997)/997.0::double))")}) loss from forecasts, range(11) r(i) group by 1,2),
o as (select *, (sum(loss) over (partition by weight)-loss)/(sum(n) over (partition by weight)-n) rest from w), l as (select *, min(rest) over (partition by fold) least from o)
select fold, arg_min(weight, struct_pack(r:=round(rest,9), w:=weight)) weight, round(arg_min(loss/n, struct_pack(r:=round(rest,9), w:=weight)),6) loss, min(weight) filter (rest<=least+1e-3) flat_from, max(weight) filter (rest<=least+1e-3) flat_to from l group by fold""")
def e14(s, d):
    out = bt.best_weights(bt.blend_table(two_forecasts(s, d), "p", "q", "y", "fold"), "fold")
    return out.withColumn("loss", F.round("loss", 6))


@query("e15_out_of_fold", "with s as (select team, season, sum(gf) g, count(gf) n from team_rows group by 1,2) select team, season, round((sum(g) over w-g)/(sum(n) over w-n),6) as forecast from s window w as (partition by team)")
def e15(s, d):
    rows = bt.out_of_fold(t.team_rows(t.matches(s, d)), "team", "season", "gf")
    return rows.withColumn("forecast", F.round("forecast", 6))


@query("e16_walk_forward", """with s as (select team, cast(date_trunc('month', match_date) as date) as month, sum(gf) g, count(gf) n from team_rows group by 1,2) select team, month, coalesce(sum(n) over w,0)::bigint n, round((coalesce(sum(g) over w,0)+6*1.37171317::double)/(coalesce(sum(n) over w,0)+6),6) as forecast from s window w as (partition by team order by month rows between unbounded preceding and 1 preceding)""")
def e16(s, d):
    rows = t.team_rows(t.matches(s, d)).withColumn("month", F.trunc("match_date", "month"))
    return bt.walk_forward(rows, "team", "month", "gf", 1.37171317).withColumn("forecast", F.round("forecast", 6))


@query("e18_replay", f"""with {SETTLED}, st as (select *, case when minutes>0 then 1+(minutes>=60)::int+5*goals+3*assists+case when minutes>=60 and conceded=0 and position in ('GKP','DEF') then 4 else 0 end-yellow-3*red end as stored from scored),
r as (select case when stored is null then 'missing' when points=stored then 'exact' when abs(points-stored)=1 then 'one off' when points>stored then 'higher' else 'lower' end as "class" from st) select "class", count(*) n, round(count(*)/sum(count(*)) over (),6) as "share" from r group by 1""")
def e18(s, d):
    """Points under today's rules against those that simpler rules of before had stored for who played."""
    sheet = F.when((F.col("minutes") >= 60) & (F.col("conceded") == 0) & F.col("position").isin("GKP", "DEF"), 4).otherwise(0)
    before = 1 + (F.col("minutes") >= 60).cast("int") + 5 * F.col("goals") + 3 * F.col("assists") + sheet - F.col("yellow") - 3 * F.col("red")
    rows = pl.scored(t.appearances(s, d)).withColumn("stored", F.when(F.col("minutes") > 0, before))
    return bt.replay(rows, pl.points(rows), "stored")


@query("e19_field_calibration", "select round(avg(abs(share-real)),6) mean, round(max(abs(share-real)),6) worst, avg(abs(share-real))<=0.5 and max(abs(share-real))<=0.6 calibrated from (select selected_by/100 as share, goals/20.0::double as real from players)")
def e19(s, d):
    rows = t.players(s, d).select((F.col("selected_by") / 100).alias("share"), (F.col("goals") / 20.0).alias("real"))
    return bt.field_calibration(rows, "share", "real", 0.5, 0.6)


@query("e20_contract", """select rule, n from (select count(*) filter (not coalesce(price between 45 and 120, false)) price, count(*) filter (not coalesce(chance between 0 and 75, false)) chance, count(*) filter (not coalesce(xp>0, false)) xp, count(*) filter (not coalesce(player_id>=0, false)) id from players) unpivot (n for rule in (price, chance, xp, id))""")
def e20(s, d):
    return bt.violations(t.players(s, d), {"price": F.col("price").between(45, 120), "chance": F.col("chance").between(0, 75), "xp": F.col("xp") > 0, "id": F.col("player_id") >= 0})


@query("a30_coverage", "select season, count(*) n, round(count(p.player_id)/count(*),6) as share from appearances a left join (select player_id from players where status='a') p using (player_id) group by season")
def a30(s, d):
    return bt.coverage(t.appearances(s, d), t.players(s, d).where("status = 'a'"), "player_id", "season")


@query("a32_j6_realised", f"with {SETTLED} select player_id, sum(points)::bigint points, max(minutes)>=1 as played from scored join (select player_id from players) using (player_id) group by player_id")
def a32(s, d):
    rows = pl.scored(t.appearances(s, d)).join(t.players(s, d).select("player_id"), "player_id")
    return bt.realised(rows, "player_id")


@query("a22_noise", "select player_id, count(*) n, round(case when count(*)>=30 then stddev_samp(value) end,6) sd, round(case when count(*)>=30 then stddev_samp(value)/sqrt(count(*)) end,6) se from claims group by player_id")
def a22(s, d):
    return bt.noise(t.claims(s, d), "player_id", "value")


@query("m18_gates", """with m as (select 'p'||(player_id%40) as name, price/100.0::double as now, price/100.0::double+(player_id%7-3)/10.0::double as proposed, minutes%30 as n, xp as gain, player_id from players), r as (select 'p'||i as name, 0.3::double low, 1.2::double high, case when i%5=0 then 'risk' else 'model' end tier, 0.2::double step from range(30) t(i)),
j as (select m.name, player_id, tier is not null registered, coalesce(tier<>'risk',false) not_risk, coalesce(proposed between low and high,false) as bounds, coalesce(abs(proposed-now)<=step,false) as step, n>=10 as enough, gain>0 as better from m left join r using (name))
select name, registered, not_risk, bounds, step, enough, better, case when not registered then 'registered' when not not_risk then 'not_risk' when not bounds then 'bounds' when not step then 'step' when not enough then 'enough' when not better then 'better' end as failed from j""")
def m18(s, d):
    key = F.col("player_id")
    moves = t.players(s, d).select(F.concat(F.lit("p"), key % 40).alias("name"), (F.col("price") / 100.0).alias("now"), (F.col("price") / 100.0 + (key % 7 - 3) / 10.0).alias("proposed"), (F.col("minutes") % 30).alias("n"), F.col("xp").alias("gain"))
    registry = s.range(30).select(F.concat(F.lit("p"), "id").alias("name"), F.lit(0.3).alias("low"), F.lit(1.2).alias("high"), F.when(F.col("id") % 5 == 0, "risk").otherwise("model").alias("tier"), F.lit(0.2).alias("step"))
    return bt.gates(moves, registry)


@query("o10_t10_v11_survival", "select claim_type as move, count(*) n, sum((value>60)::int)::bigint wins, round(sum((value>60)::int)/count(*),6) as share, case when sum((value>60)::int)/count(*)>=0.8 then 'firm' when sum((value>60)::int)/count(*)>=0.5 then 'likely' else 'fragile' end band from claims group by 1")
def o10(s, d):
    rows = t.claims(s, d).select(F.col("claim_type").alias("move"), (F.col("value") > 60).alias("won"))
    return bt.survival(rows, "move", "won")
