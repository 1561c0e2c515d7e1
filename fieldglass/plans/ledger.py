"""Queries on ledgers, windows of news, streaks, versions and rounds."""

from pyspark.sql import functions as F

from fieldglass.operators import ledgers as lg, logs, players as pl
from fieldglass.sources import tables as t

from .logs import CLAIMS, claims, snapshots
from .registry import query


def starts(s, d):
    """A player's first purchase as the start of its match."""
    return claims(s, d).where("claim_type = 'purchase'").groupBy("player_id").agg(F.min("ts").alias("start"))


@query("k5_last_before_start", f"with {CLAIMS}, f as (select player_id, min(ts) st from cl where claim_type='purchase' group by 1) select player_id, arg_max(value, ts) as value, max(ts) as ts from cl join f using (player_id) where claim_type='view' and ts<st group by player_id")
def k5(s, d):
    return lg.last_before(claims(s, d).where("claim_type = 'view'"), starts(s, d), "player_id", "ts", "start", "value")


@query("l8_p13_news_window", f"""with {CLAIMS}, n as (select claim_id, ts, (select min(p.ts) from cl p where p.claim_type='purchase' and p.player_id=v.player_id and p.ts>=v.ts+interval 2 hour) st from cl v where claim_type='view') select claim_id from n where st<=ts+interval 72 hour""")
def l8(s, d):
    c = claims(s, d)
    kickoffs = c.where("claim_type = 'purchase'").select("player_id", F.col("ts").alias("start"))
    return lg.in_window(c.where("claim_type = 'view'").select("claim_id", "player_id", "ts"), kickoffs, "player_id", "ts", "start").select("claim_id")


@query("l9_failure_streaks", f"""with {CLAIMS}, r as (select *, claim_type in ('error','signup') f, row_number() over (partition by player_id order by ts, claim_id) n from cl), g as (select *, coalesce(max(case when not f then n end) over (partition by player_id order by n), 0) lastgood from r),
k as (select claim_id, case when f then n-lastgood else 0 end streak from g) select claim_id, streak, case when streak>=3 then 'escalate' when streak>0 then 'failing' else 'fine' end as status from k""")
def l9(s, d):
    return lg.streaks(claims(s, d), "player_id", ["ts", "claim_id"], F.col("claim_type").isin("error", "signup")).select("claim_id", "streak", "status")


@query("l11_settled", f"with {CLAIMS} select player_id, arg_max(value, struct_pack(f:=claim_type='purchase', t:=ts, v:=value)) as value, max(claim_type='purchase') as is_final from cl group by player_id")
def l11(s, d):
    return lg.settled(claims(s, d).withColumn("is_final", F.col("claim_type") == "purchase"), ["player_id"], "is_final", "ts", "value")


@query("l13_merged_feeds", f"with {CLAIMS} select player_id, max(claim_id) claim_id from (select player_id, claim_id, ts, row_number() over (partition by player_id order by ts desc, claim_type='view' desc) n from cl where claim_type in ('view','click')) where n=1 group by 1")
def l13(s, d):
    c = claims(s, d).select("player_id", "claim_id", "ts", "claim_type")
    return lg.merged(c.where("claim_type = 'click'"), c.where("claim_type = 'view'"), "player_id", "ts").select("player_id", "claim_id")


def versions(s, d):
    """Seasons' mean minutes by position as versions of a parameter."""
    rows = t.appearances(s, d).groupBy(F.col("position").alias("name"), F.col("season").alias("version")).agg(F.round(F.avg("minutes"), 6).alias("value"))
    return rows.select("name", (F.col("version") - 1994).alias("version"), "value")


VERSIONS = "v as (select position as name, season-1994 as version, round(avg(minutes),6) value from appearances group by 1,2), w as (select * from v union all select v.name, l.m+1, v.value from v join (select name, max(version) m from v group by 1) l using (name) where v.version=2)"


@query("l14_rollback", f"with {VERSIONS} select name, version, value from w")
def l14(s, d):
    v = versions(s, d)
    return lg.rolled_back(v, "name", v.where("version = 2").select("name", "version"))


@query("l14_current_values", f"with {VERSIONS} select name, max(version) as version, arg_max(value, version) as value from w group by name")
def l14_now(s, d):
    return lg.current(l14(s, d), "name")


@query("w18_prices_paid", f"""with {CLAIMS}, m as (select * from cl where claim_type in ('purchase','error')), p as (select *, last_value(case when claim_type='purchase' then value end ignore nulls) over (partition by player_id order by ts, claim_id rows between unbounded preceding and 1 preceding) paid from m) select claim_id, paid from p where claim_type='error'""")
def w18(s, d):
    moves = claims(s, d).where("claim_type in ('purchase', 'error')")
    return lg.prices_paid(moves, "player_id", ["ts", "claim_id"], F.col("claim_type") == "purchase", "value").select("claim_id", "paid")


@query("u8_fullest_rows", "select player_id, season, round, row_id from (select *, row_number() over (partition by player_id, season, round order by minutes desc, goals desc, row_id desc) n from appearances) where n=1")
def u8(s, d):
    a = t.appearances(s, d).select("player_id", "season", "round", "minutes", "goals", "row_id")
    return lg.fullest(a, ["player_id", "season", "round"], ["minutes", "goals", "row_id"]).select("player_id", "season", "round", "row_id")


@query("u9_items_by_digest", f"with {CLAIMS} select md5(claim_type||'|'||source) digest, count(distinct player_id) n_players, min(player_id) first_player, min(ts) first_seen from cl group by claim_type, source")
def u9(s, d):
    return lg.by_digest(claims(s, d), [F.col("claim_type"), F.col("source").cast("string")], "player_id", "ts")


def rounds(s, d):
    m = t.matches(s, d)
    return m.groupBy(F.col("season").alias("round")).agg((F.max("match_date") < F.lit("1998-06-01").cast("date")).alias("finished")).withColumn("is_current", F.lit(False))


@query("p8_current_round", "select coalesce(min(case when not f then r end), max(r)) as round from (select season r, max(match_date)<date '1998-06-01' f from matches group by 1)")
def p8(s, d):
    return lg.current_round(rounds(s, d))


@query("p7_upcoming", "select match_id from matches where season=1998 and match_date>date '1998-06-01'")
def p7(s, d):
    now = F.lit("1998-06-01").cast("date")
    fixtures = t.matches(s, d).select("match_id", F.col("season").alias("round"), F.col("match_date").alias("start"), (F.col("match_date") < now).alias("finished"))
    return lg.upcoming(fixtures, rounds(s, d), now).select("match_id")


@query("p12_recent_or_undated", "select claim_id from claims where k%5=0 or ts>=timestamp '2024-01-20'")
def p12(s, d):
    c = t.claims(s, d).withColumn("ts", F.when(F.col("k") % 5 > 0, F.col("ts")))
    return lg.recent(c, "ts", F.lit("2024-01-20").cast("timestamp_ntz")).select("claim_id")


@query("l7_flips_reported", f"""with {CLAIMS}, a as (select player_id, claim_type, arg_max(value, ts) v from cl where ts<'2024-01-15' group by 1,2), b as (select player_id, claim_type, arg_max(value, ts) v from cl where ts>='2024-01-05' group by 1,2),
c as (select player_id, claim_type, a.v va, b.v vb from a full join b using (player_id, claim_type) where a.v is distinct from b.v),
r as (select *, (coalesce(va,100)>=50)<>(coalesce(vb,100)>=50) flip, case when va is null then vb<100 when vb is null then true else abs(va-vb)>=20 end m from c) select player_id, claim_type, flip, flip or m as reported from r""")
def l7(s, d):
    changed = logs.diff(*snapshots(s, d), ["player_id", "claim_type"], "value").withColumn("reported", logs.material("chance", F.col("before"), F.col("after"), {"chance": 20}))
    return lg.reported(changed).select("player_id", "claim_type", "flip", "reported")


FREE = """with recursive u as (select team_id, season w, (count(*)%4)::int used from appearances group by 1,2), f as (select team_id, min(w) w, 1 free from u group by 1 union all select u.team_id, n.w, least(5, greatest(0, f.free-u.used)+1) from f join u on u.team_id=f.team_id and u.w=f.w join u n on n.team_id=f.team_id and n.w=(select min(x.w) from u x where x.team_id=f.team_id and x.w>f.w))"""


@query("w17_free_transfers", FREE + " select team_id, w as season, free from f")
def w17(s, d):
    used = t.appearances(s, d).groupBy("team_id", "season").agg((F.count("*") % 4).cast("int").alias("used"))
    return lg.carried(used, "team_id", "season", "used")


@query("a31_club_bursts", f"with {CLAIMS} select player_id, date_trunc('day', ts) as day, count(distinct source) channels from cl group by 1,2 having count(distinct source)>=2")
def a31(s, d):
    per = claims(s, d).groupBy("player_id", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day")).agg(F.count_distinct("source").alias("channels"))
    return per.where("channels >= 2")


@query("p17_claim_validity", f"""with {CLAIMS}, r as (select case when ts>timestamp '2024-01-25' then 'from the future' when value not between 0 and 95 then 'out of range' when claim_type='signup' then 'unknown type' end reason from cl) select reason, count(*) n from r group by 1""")
def p17(s, d):
    kinds = ["view", "click", "purchase", "error"]
    rows = logs.validated(claims(s, d), F.lit("2024-01-25").cast("timestamp_ntz"), kinds, 0, 95)
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query("l5_permanent_exit", f"""with {CLAIMS}, l as (select player_id, claim_type, arg_max(value, struct_pack(t:=ts, c:=claim_id)) v from cl group by 1,2), e as (select player_id from cl where claim_type='error' and value>=95 group by 1)
select player_id, claim_type, case when e.player_id is null then v else 0 end as value, e.player_id is not null as gone from l left join e using (player_id)""")
def l5_exit(s, d):
    c = claims(s, d)
    last = c.groupBy("player_id", "claim_type").agg(F.max_by("value", F.struct("ts", "claim_id")).alias("value"))
    return logs.with_exits(last, c.where("claim_type = 'error' and value >= 95"))


@query("t6_top_performers", "select season, round, player_id, row_id from (select *, row_number() over (partition by season, round order by goals desc, assists desc, player_id, row_id) n from appearances) where n<=5")
def t6(s, d):
    return pl.top_in_group(t.appearances(s, d), ["season", "round"], [F.desc("goals"), F.desc("assists"), "player_id", "row_id"], 5).select("season", "round", "player_id", "row_id")


@query("f15_digests", "select match_id, substr(sha256('{\"home_id\":'||home_id||',\"away_id\":'||away_id||'}'),1,16) as digest from matches")
def f15(s, d):
    return t.matches(s, d).select("match_id", logs.digest("home_id", "away_id").alias("digest"))
