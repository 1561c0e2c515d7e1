"""Queries on squads, gates, samples and documents of unknown shape."""

from pyspark.sql import Window as W, functions as F

from fieldglass.operators import gates as gt, logs, players as pl, samples as sp, squads as sq
from fieldglass.sources import tables as t

from .evaluation import SETTLED
from .registry import query
from .views import LINE, lineups


def last_rounds(s, d):
    """Clubs' squads with what each player did last; who never appeared did not play."""
    did = logs.latest(pl.scored(t.appearances(s, d)), ["player_id"], [F.desc("day"), F.desc("row_id")]).select("player_id", F.col("minutes").alias("m"), "yellow", "red", F.col("points").cast("long").alias("points"))
    rows = lineups(s, d).join(did, "player_id", "left")
    played = F.coalesce(sq.appeared(F.col("m"), F.col("yellow"), F.col("red")), F.lit(False))
    place = F.row_number().over(W.partitionBy("team_id", "starts").orderBy(F.col("position") != "GKP", "player_id"))
    role = F.when((F.col("position") == "MID") & (F.col("n") == 1), "captain").when((F.col("position") == "FWD") & (F.col("n") == 1), "vice")
    return rows.select("team_id", "player_id", "position", "starts", place.alias("place"), played.alias("played"), F.coalesce("points", F.lit(0)).alias("points"), role.alias("role"), F.lit(None).cast("string").alias("chip"))


@query("o6_resolved")
def o6_resolved(s, d):
    """Beyond SQL, as each substitution depends on those before; held against a plain loop in the tests."""
    out = sq.resolved_lineups(last_rounds(s, d), "team_id")
    pairs = F.array_join(F.transform("subs", lambda x: F.concat_ws(">", x["out_id"], x["in_id"])), " ")
    return out.select("team_id", F.array_join(F.col("counted").cast("array<string>"), " ").alias("counted"), pairs.alias("subs"), "captain", "multiplier", "vice_used", "total")


@query("o6_captains", f"""with {SETTLED}, {LINE}, lt as (select player_id, minutes m, yellow, red from appearances qualify row_number() over (partition by player_id order by day desc, row_id desc)=1),
c as (select l.team_id, l.player_id, position, coalesce(m>=1 or yellow>0 or red>0, false) played from lineups l left join lt using (player_id) qualify row_number() over (partition by team_id, position order by l.player_id)=1)
select a.team_id, case when not a.played and b.played then b.player_id else a.player_id end as captain, coalesce(not a.played and b.played, false) as vice_used from c a left join c b on a.team_id=b.team_id and b.position='FWD' where a.position='MID'""")
def o6_captains(s, d):
    return sq.resolved_lineups(last_rounds(s, d), "team_id").where("captain is not null").select("team_id", "captain", "vice_used")


@query("t8_transfer_plans")
def t8_transfer_plans(s, d):
    """Beyond SQL; equal to an exhaustive search on small squads in the tests."""
    market = t.players(s, d).withColumn("league", F.expr("team_id div 20"))
    own = lineups(s, d).withColumn("league", F.expr("team_id div 20"))
    banks = own.select("team_id").distinct().select("team_id", F.lit(20).alias("bank"))
    out = sq.transfer_plans(own, market, banks, "team_id", "league")
    pairs = F.array_join(F.transform("moves", lambda x: F.concat_ws(">", x["out_id"], x["in_id"])), " ")
    return out.select("team_id", "depth", "rank", F.round("delta", 6).alias("delta"), "bank", pairs.alias("moves"))


def brands(s, d):
    """Brands as parameters: their price level now, as sold, its range, who sold how much, and the monthly gain of discount over tax."""
    part, line = t.table(s, d, "part"), t.table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    tier = F.when(F.col("n") % 4 == 0, "C").when(F.col("n") % 4 == 1, "S").otherwise("F")
    registry = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"), F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("current"), F.min("p_type").alias("block"))
    sold = line.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("name")), "l_partkey")
    proposed = sold.groupBy("name").agg(F.round(F.avg(F.least(F.col("l_extendedprice") / F.col("l_quantity"), F.lit(2000.0))), 6).alias("proposed"))
    moves = registry.join(proposed, "name").select("name", "block", "current", "proposed")
    samples = gt.effective_samples(sold, "name", "l_suppkey", "l_discount")
    months = sold.groupBy("name", F.trunc("l_shipdate", "month").alias("month")).agg((F.avg("l_discount") - F.avg("l_tax")).alias("gain"))
    return moves, registry.select("name", "low", "high", tier.alias("tier")), samples, gt.out_of_sample(months, "name", "gain")


BRANDS = """rg as (select p_brand as name, min(p_retailprice) low, max(p_retailprice) high, case count(*)%4 when 0 then 'C' when 1 then 'S' else 'F' end tier, round(avg(p_retailprice),6) as current, min(p_type) as block from part group by 1),
so as (select p_brand as name, lineitem.* from lineitem join part on p_partkey=l_partkey),
pr as (select name, round(avg(least(l_extendedprice/l_quantity,2000)),6) proposed from so group by 1),
bk as (select name, l_suppkey, count(*) m, avg(l_discount) mean, var_pop(l_discount) spread from so group by 1,2),
bc as (select *, sum(m*mean) over (partition by name)/sum(m) over (partition by name) c from bk),
an as (select name, sum(m)::bigint n, count(*) k, sum(m*m) sq, sum(m*spread) wi, sum(m*(mean-c)*(mean-c)) be from bc group by 1),
ic as (select *, (n-sq/n)/(k-1) m0, case when n>k then wi/(n-k) else 0 end ins, be/(k-1) amo from an),
es as (select name, n, k as blocks, case when k>1 then greatest(0,least(1,case when amo+(m0-1)*ins>0 then (amo-ins)/(amo+(m0-1)*ins) else 0 end)) else 1 end as correlation, n/(1+(sq/n-1)*(case when k>1 then greatest(0,least(1,case when amo+(m0-1)*ins>0 then (amo-ins)/(amo+(m0-1)*ins) else 0 end)) else 1 end)) as effective from ic),
mo as (select name, date_trunc('month', l_shipdate) mth, avg(l_discount)-avg(l_tax) gain from so group by 1,2),
os as (select name, count(*) rounds, avg(gain) mean, stddev_samp(gain) sd from mo group by 1),
oo as (select name, rounds, mean, case when rounds>=10 then case when sd=0 then mean else mean-sd*sqrt(2*(rounds+1)/(rounds*rounds)*ln(sqrt(rounds+1.0::double)/0.01::double)) end end as lower from os)"""


@query("m18_effective_samples", f"with {BRANDS} select name, n, blocks, round(correlation,6) as correlation, round(effective,4) as effective, rounds, round(lower,6) as lower from es join oo using (name)")
def m18_effective(s, d):
    _, _, samples, gains = brands(s, d)
    return samples.join(gains, "name").select("name", "n", "blocks", F.round("correlation", 6).alias("correlation"), F.round("effective", 4).alias("effective"), "rounds", F.round("lower", 6).alias("lower"))


@query("m18_promotions", f"""with {BRANDS}, g as (select name, block, true as registered, tier<>'risk' as not_risk, tier in ('F','S') as tier, proposed between low and high as bounds, high>low and abs(proposed-current)<=0.25::double*(high-low) as move_size, count(*) over (partition by block)<=4 as block_size, effective>=500*count(*) over (partition by block) as effective_sample, coalesce(lower>0,false) as out_of_sample from rg join pr using (name) join es using (name) join oo using (name))
select *, concat_ws(' ', case when not tier then 'tier' end, case when not bounds then 'bounds' end, case when not move_size then 'move_size' end, case when not block_size then 'block_size' end, case when not effective_sample then 'effective_sample' end, case when not out_of_sample then 'out_of_sample' end) as failed, tier and bounds and move_size and block_size and effective_sample and out_of_sample as promoted from g""")
def m18_promotions(s, d):
    return gt.promotions(*brands(s, d))


@query("a11_bonus_samples", "with b as (select position, least(greatest(goals,0),2) goals, least(greatest(assists,0),2) assists, conceded=0 and minutes>=60 as clean, actions, md5(row_id::varchar) mark from appearances where minutes>0) select position, goals, assists, clean, count(*) n, round(avg(actions),6) as mean, array_to_string(list(actions order by mark)[1:256], ' ') as sample from b group by 1,2,3,4")
def a11_bonus_samples(s, d):
    """The spread of a player's defensive actions by what else happened, as the values of 256 rows of each bucket."""
    rows = sp.bucket_samples(sp.outcome_buckets(t.appearances(s, d)), ["position", "goals", "assists", "clean"], "row_id", "actions")
    return rows.select("position", "goals", "assists", "clean", "n", F.round("mean", 6).alias("mean"), F.array_join(F.col("sample").cast("array<string>"), " ").alias("sample"))


@query("p20_f64_stripped", """select event_id, '{"a":[{"v":'||user_id||'},['||(json_extract_string(props,'$.k'))||',"'||event_type||'"]],"z":'||replace(props,' ','')||'}' as body, substr(sha256('{"a":[{"manager_name":"m'||user_id||'","v":'||user_id||'},['||(json_extract_string(props,'$.k'))||',"'||event_type||'"]],"entry_id":'||user_id||',"z":'||replace(props,' ','')||'}'),1,16) as digest from events""")
def p20(s, d):
    """Events as nested documents with private parts in an object and inside a list."""
    k, e = F.get_json_object("props", "$.k"), t.table(s, d, "events")
    text = F.concat(F.lit('{"z": '), "props", F.lit(', "entry_id": '), "user_id", F.lit(', "a": [{"v": '), "user_id", F.lit(', "manager_name": "m'), "user_id", F.lit('"}, ['), k, F.lit(', "'), "event_type", F.lit('"]]}'))
    return e.select("event_id", sp.stripped(text).alias("body"), sp.digest(text).alias("digest"))
