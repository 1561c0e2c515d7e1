"""Queries of readers: filters, rankings, comparisons, plans."""

from pyspark.sql import functions as F

from fieldglass.operators import players as pl, views as vw
from fieldglass.sources import tables as t

from .registry import query


def bets(s, d):
    rows = t.prices(t.matches(s, d)).withColumn("edge", F.round(F.col("price") % 0.23 - 0.05, 6))
    return rows.select("match_id", "book", "outcome", F.lit("1x2").alias("market"), "edge", F.when(F.col("edge") >= 0.12, "high").when(F.col("edge") >= 0.05, "medium").otherwise("low").alias("tier"), (F.col("price") > 2).alias("fair"), F.concat(F.lit("Match "), "match_id", F.lit(" "), "outcome").alias("label"))


@query("p22_p23_bets_wanted", "select match_id, book, outcome from (select *, round(price%0.23::double-0.05::double,6) e from prices) where e>=0.05 and price>2 and lower('Match '||match_id||' '||outcome) like '%1 h%'")
def p22(s, d):
    return vw.bets_wanted(bets(s, d), ["1x2"], ["high", "medium"], 0.05, True, "1 H ").select("match_id", "book", "outcome")


@query("t3_t5_leaderboards", """with m as (select player_id, unnest(['xp','goals','value','differential','involved']) category, unnest([xp, goals, xp/price, case when selected_by<=2 then xp end, goals+assists]) score from players where minutes>=45), r as (select *, row_number() over (partition by category order by score desc, player_id) rank from m where score is not null) select category, rank, player_id, round(score,6) as score from r where rank<=10""")
def t3(s, d):
    metrics = {"xp": F.col("xp"), "goals": F.col("goals"), "value": F.col("xp") / F.col("price"), "differential": F.when(F.col("selected_by") <= 2, F.col("xp")), "involved": F.col("goals") + F.col("assists")}
    return vw.leaderboards(t.players(s, d), metrics).withColumn("score", F.round("score", 6))


@query("j16_compared", "select coalesce(a.player_id, b.player_id) as player_id, a.xp, b.goals from (select player_id, xp from players where status in ('a','d')) a full join (select player_id, goals from players where minutes>=900) b using (player_id) where coalesce(a.player_id, b.player_id) in (select home_id from matches)")
def j16(s, d):
    p = t.players(s, d)
    return vw.compared(p.where("status in ('a', 'd')").select("player_id", "xp"), p.where("minutes >= 900").select("player_id", "goals"), t.matches(s, d).select(F.col("home_id").cast("long").alias("player_id")).distinct())


@query("v4_leaders", "select 'goals' as metric, player_id from players where goals=(select max(goals) from players) union all select 'price', player_id from players where price=(select max(price) from players)")
def v4(s, d):
    return vw.leaders(t.players(s, d).withColumn("flat", F.lit(1)), ["goals", "price", "flat"])


@query("j23_nearest", """with m as (select player_id mark_id, price+0.3::double x, goals*3+0.2::double y from players), p as (select player_id, price x, goals*3 y from players), d as (select mark_id, player_id, sqrt(power(p.x-m.x,2)+power(p.y-m.y,2)) far from m, p) select mark_id, arg_min(player_id, struct_pack(f:=far, p:=player_id)) as player_id, round(min(far),6) far from d where far<=4 group by 1""")
def j23(s, d):
    p = t.players(s, d)
    marks = p.select(F.col("player_id").alias("mark_id"), (F.col("price") + 0.3).alias("x"), (F.col("goals") * 3 + 0.2).alias("y"))
    return vw.nearest(p.select("player_id", F.col("price").alias("x"), (F.col("goals") * 3).alias("y")), marks, 4.0).withColumn("far", F.round("far", 6))


@query("j15_squad_projections", """with p as (select player_id, case when player_id%6=0 then 'same' else 'n'||player_id end nm, position, xp from players where player_id%2=0), q as (select player_id, case when player_id%6=0 then 'same' when player_id%2=1 then 'n'||(player_id-1) else 'n'||player_id end nm, position from players), n as (select nm, position, min(player_id) i, min(xp) x from p group by 1,2 having count(*)=1)
select q.player_id, case when p.xp is not null then q.player_id else n.i end as matched, coalesce(p.xp, n.x) as xp from q left join p using (player_id) left join n on n.nm=q.nm and n.position=q.position""")
def j15(s, d):
    key = F.col("player_id")
    p = t.players(s, d)
    known = p.where("player_id % 2 = 0").select("player_id", F.when(key % 6 == 0, "Same ").otherwise(F.concat(F.lit("N"), key)).alias("name"), "position", "xp")
    squad = p.select("player_id", F.when(key % 6 == 0, "same").when(key % 2 == 1, F.concat(F.lit("n"), key - 1)).otherwise(F.concat(F.lit("n"), key)).alias("name"), "position")
    return vw.squad_projections(squad, known)


@query("p26_zones", """with s as (select season, team, sum(case when gf>ga then 3 when gf=ga then 1 else 0 end) pts from team_rows where gf is not null group by 1,2), r as (select *, row_number() over (partition by season order by pts desc, team) n from s)
select season, team, case when n<=4 then 'champions' when n=5 then 'europa' when n=6 then 'conference' when n>17 then 'relegation' else 'middle' end as zone from r""")
def p26(s, d):
    points = t.team_rows(t.matches(s, d)).where("gf is not null").groupBy("season", "team").agg(F.sum(F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)).alias("pts"))
    ranked = points.withColumn("n", F.row_number().over(pl.W.partitionBy("season").orderBy(F.desc("pts"), "team")))
    return ranked.select("season", "team", vw.zone(F.col("n")).alias("zone"))


@query("a33_j24_fixture_stats", """with l as (select season, round, player_id, unnest(['goals','assists','saves']) stat, unnest([goals,assists,saves]) v from appearances), r as (select *, row_number() over (partition by season, round, stat order by v desc, player_id) n from l where v>0)
select season, round, stat, string_agg(player_id||'='||v, ' ' order by n) as top from r where n<=5 group by 1,2,3""")
def a33(s, d):
    rows = vw.fixture_stats(t.appearances(s, d), ["season", "round"], ["goals", "assists", "saves"])
    return rows.select("season", "round", "stat", F.array_join(F.transform("top", lambda r: F.concat_ws("=", r["player_id"].cast("string"), r["value"].cast("string"))), " ").alias("top"))


@query("a34_flagged", "select team_id, count(*) filter (status<>'a' or coalesce(chance,100)<100) flagged, count(*) filter (not (status<>'a' or coalesce(chance,100)<100)) unflagged, count(*) total from players group by 1")
def a34(s, d):
    return vw.flagged(t.players(s, d))


def lineups(s, d):
    """Clubs as squads of fifteen: two, five, five and three of each position by id; starters are the first ones."""
    p = t.players(s, d)
    n = F.row_number().over(pl.W.partitionBy("team_id", "position").orderBy("player_id"))
    quota = F.coalesce(*[F.when(F.col("position") == k, v) for k, v in pl.QUOTA.items()])
    starts = F.coalesce(*[F.when(F.col("position") == k, v) for k, v in {"GKP": 1, "DEF": 4, "MID": 4, "FWD": 2}.items()])
    rows = p.withColumn("n", n).where(F.col("n") <= quota).withColumn("starts", F.col("n") <= starts)
    bench = F.row_number().over(pl.W.partitionBy("team_id").orderBy("starts", F.col("position") == "GKP", "player_id"))
    return rows.withColumn("bench", bench).withColumn("played", F.expr("player_id * 7 div 20 % 3 > 0")).withColumn("captain", (F.col("position") == "MID") & (F.col("n") == 1))


LINE = """ln as (select *, row_number() over (partition by team_id, position order by player_id) n from players), lineups as (select *, n<=case position when 'GKP' then 1 when 'DEF' then 4 when 'MID' then 4 else 2 end starts, position='MID' and n=1 captain from ln where n<=case position when 'GKP' then 2 when 'DEF' then 5 when 'MID' then 5 else 3 end)"""


@query("v1_eleven_totals", f"with {LINE} select team_id, round(sum(case when captain then 2*xp else xp end),6) total from lineups where starts group by 1")
def v1(s, d):
    return vw.lineup_total(lineups(s, d), "team_id")


@query("v1_swaps", f"""with {LINE}, b as (select team_id, position, arg_max(player_id, struct_pack(x:=xp, p:=-player_id)) in_id, max(xp) i from lineups where not starts group by 1,2), o as (select team_id, position, arg_min(player_id, struct_pack(x:=xp, p:=player_id)) out_id, min(xp) o from lineups where starts group by 1,2) select team_id, position, out_id, in_id, round(i-o,6) gain from b join o using (team_id, position) where i-o>0.01""")
def v1_swaps(s, d):
    return vw.swaps(lineups(s, d), "team_id")


@query("o5_legal_eleven", """with r as (select *, row_number() over (partition by team_id, position order by xp desc, player_id) n from players), k as (select *, n<=case position when 'GKP' then 1 when 'DEF' then 3 when 'MID' then 2 else 1 end must from r where n<=case position when 'GKP' then 1 when 'DEF' then 5 when 'MID' then 5 else 3 end),
q as (select *, row_number() over (partition by team_id order by must desc, xp desc, player_id) g from k) select team_id, player_id from q where g<=11""")
def o5(s, d):
    return vw.legal_eleven(t.players(s, d), "team_id").select("team_id", "player_id")


@query("o6_autosubs")
def o6(s, d):
    return vw.autosubs(lineups(s, d), "team_id")


@query("v8_captaincy", """with w as (select player_id%7 squad, team_id, player_id, week, (player_id*13+week*17)%101/10.0::double x from players, range(1,7) r(week)), c as (select squad, week, arg_max(player_id, struct_pack(x:=x, p:=-player_id)) captain from w group by 1,2), v as (select w.squad, w.week, arg_max(w.player_id, struct_pack(x:=x, p:=-w.player_id)) vice from w join c using (squad, week) join players p on p.player_id=captain where w.team_id<>p.team_id group by 1,2)
select squad, week, captain, vice from c left join v using (squad, week)""")
def v8(s, d):
    weeks = t.players(s, d).select((F.col("player_id") % 7).alias("squad"), "team_id", "player_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("week"))
    return vw.captaincy(weeks.withColumn("xp", (F.col("player_id") * 13 + F.col("week") * 17) % 101 / 10.0), "squad", "week")


@query("v3_plan_grid", "select player_id, max(a) filter (week=1) as w1, max(a) filter (week=2) as w2, max(a) filter (week=3) as w3 from (select player_id, 1+player_id%3 as week, case when player_id%2=0 then 'in' else 'out' end a from players) group by 1")
def v3(s, d):
    key = F.col("player_id")
    moves = t.players(s, d).select("player_id", (key % 3 + 1).cast("int").alias("week"), F.when(key % 2 == 0, "in").otherwise("out").alias("action"))
    return vw.plan_grid(moves, [1, 2, 3]).withColumnsRenamed({"1": "w1", "2": "w2", "3": "w3"})


@query("v6_artifact_states", "select claim_id, case when k%5=0 then 'absent' when k%7=0 then 'unreadable' when k%3=0 then 'empty' when value>24 then 'stale' else 'ok' end as state from claims")
def v6(s, d):
    k = F.col("k")
    return t.claims(s, d).select("claim_id", vw.artifact_state(F.when(k % 5 > 0, F.col("value")), k % 3, k % 7 > 0).alias("state"))


@query("v5_messages_by_round", "select k%10 as round, count(*) n, count(*) filter (claim_type='error') attention, arg_max(claim_id, struct_pack(u:=claim_type='error', t:=ts, c:=claim_id)) first_read from claims group by 1")
def v5(s, d):
    return vw.by_round(t.claims(s, d).select("claim_id", "ts", (F.col("k") % 10).alias("round"), (F.col("claim_type") == "error").alias("urgent")), "round")


@query("v12_squad_at_week", "with m as (select player_id, k%6 w, case when claim_id%2=0 then 'in' else 'out' end a from claims where k%6<=3), l as (select player_id, arg_max(a, struct_pack(w:=w, a:=a)) a from m group by 1) select coalesce(p.player_id, l.player_id) as player_id from (select player_id from players where status='a') p full join l using (player_id) where case when l.a is null then true else l.a='in' end")
def v12(s, d):
    moves = t.claims(s, d).select("player_id", (F.col("k") % 6).alias("week"), F.when(F.col("claim_id") % 2 == 0, "in").otherwise("out").alias("action"))
    return vw.squad_after(t.players(s, d).where("status = 'a'"), moves, F.lit(3))


@query("v14_v9_horizon", "select match_id, team, round(sum(gf) over w,6) as total, max(gf) over w as best from team_rows window w as (partition by team order by match_date, match_id rows between current row and 5 following)")
def v14(s, d):
    rows = t.team_rows(t.matches(s, d)).withColumn("at", F.struct("match_date", "match_id"))
    return vw.horizon(rows, "team", "at", "gf").select("match_id", "team", F.col("total").cast("double").alias("total"), "best")


@query("o7_o8_plan_values", """with dr as (select player_id, d as draw, (player_id*31+d*17)%23 points from players, range(20) r(d)), tt as (select position, draw, sum(points) total from players join dr using (player_id) group by 1,2) select position, round(avg(total),6) mean, round(stddev_samp(total),6) sd, round(quantile_cont(total,0.1),6) low, round(quantile_cont(total,0.9),6) high from tt group by 1""")
def o7(s, d):
    p = t.players(s, d)
    draws = p.select("player_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("draw")).withColumn("points", (F.col("player_id") * 31 + F.col("draw") * 17) % 23)
    return vw.plan_values(draws, p.select("position", "player_id"), "position")


@query("f63_f65_correct_scores", "select match_id, round(case when fthg<=6 and ftag<=6 then 0.25::double else 0 end,6) as own, 7 as rows_ from matches where fthg is not null")
def f63(s, d):
    m = t.matches(s, d).where("fthg is not null").withColumn("scores", F.create_map(F.concat_ws("-", "fthg", "ftag"), F.lit(0.25)))
    grid = vw.correct_scores(m)
    own = F.aggregate(F.flatten("grid"), F.lit(0.0), lambda a, x: a + x)
    return grid.select("match_id", F.round(own, 6).alias("own"), F.size("grid").alias("rows_"))


@query("v13_squad_order", "select player_id, row_number() over (partition by team_id order by case position when 'GKP' then 0 when 'DEF' then 1 when 'MID' then 2 else 3 end, xp desc, player_id) as place from players")
def v13(s, d):
    order = F.coalesce(*[F.when(F.col("position") == p, i) for i, p in enumerate(("GKP", "DEF", "MID", "FWD"))])
    return t.players(s, d).select("player_id", F.row_number().over(pl.W.partitionBy("team_id").orderBy(order, F.desc("xp"), "player_id")).cast("long").alias("place"))


@query("f52_roundings", "select match_id, round(match_id/4.0::double,0) as half_up, round_even(match_id/4.0::double,0) as half_even from matches")
def f52(s, d):
    quarter = F.col("match_id") / 4.0
    return t.matches(s, d).select("match_id", F.round(quarter, 0).alias("half_up"), F.bround(quarter, 0).alias("half_even"))


@query("u2_j14_players_without_claims", "select player_id from (select player_id from players union select player_id from appearances) where player_id not in (select player_id from claims)")
def u2(s, d):
    known = t.players(s, d).select("player_id").union(t.appearances(s, d).select("player_id")).distinct()
    return known.join(t.claims(s, d).select("player_id"), "player_id", "left_anti")
