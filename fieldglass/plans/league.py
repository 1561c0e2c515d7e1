"""Queries on matches: tables, records, features."""

from pyspark.sql import functions as F

from fieldglass.operators import features, league
from fieldglass.sources import tables as t

from .registry import query

M = t.matches


def rows(s, d):
    return t.team_rows(M(s, d))


@query("a1_league_table", """
with done as (select * from team_rows where gf is not null and ga is not null),
recent as (select team, string_agg(r, '' order by rn desc) as form from (select team, case when gf>ga then 'W' when gf=ga then 'D' else 'L' end r, row_number() over (partition by team order by match_date desc, match_id desc) rn from done) where rn<=5 group by team),
tab as (select team, count(*) played, sum((gf>ga)::int)::bigint won, sum((gf=ga)::int)::bigint drawn, sum((gf<ga)::int)::bigint lost, sum(gf)::bigint gf, sum(ga)::bigint ga from done group by team)
select team, played, won, drawn, lost, gf, ga, gf-ga as gd, 3*won+drawn as points, form, row_number() over (order by 3*won+drawn desc, gf-ga desc, gf desc, team) as position from tab join recent using (team)""")
def a1(s, d):
    return league.standings(rows(s, d))


@query("a2_referee_profiles", """select referee, count(*) n, round(avg(hy+ay),6) mean, round(stddev_samp(hy+ay),6) sd, round(case when avg(hy+ay)>0 then stddev_samp(hy+ay)/avg(hy+ay) end,6) cv, round(case when sum(hy+ay)>0 then sum(hy)/sum(hy+ay)-0.5 end,6) home_bias from matches where hy is not null group by referee having count(*)>=3""")
def a2(s, d):
    return league.referee_profiles(M(s, d))


@query("a3_referee_multiplier", """with p as (select referee, count(*) n, round(avg(hy+ay),6) mean from matches where hy is not null group by referee having count(*)>=3)
select referee, round(mean/(select avg(mean) from p where n>=5),6) as multiplier from p""")
def a3(s, d):
    return league.referee_multiplier(league.referee_profiles(M(s, d)))


@query("a4_squad_availability", """select team_id, round(avg((status in ('a','d'))::int::double),6) available, round(avg(xp),6) form, sum(goals)::bigint goals from players where minutes>90 group by team_id""")
def a4(s, d):
    return league.availability(t.players(s, d))


@query("a5_shots_both_roles", """select team, round(avg(shots),6) average, count(shots) n from team_rows group by team""")
def a5(s, d):
    return league.home_away_average(rows(s, d), "shots")


@query("a6_head_to_head", """with p as (select *, least(home_id,away_id) a, greatest(home_id,away_id) b, case when fthg>ftag then home_id when fthg<ftag then away_id end w, row_number() over (partition by least(home_id,away_id), greatest(home_id,away_id) order by match_date desc, match_id desc) rn from matches where fthg is not null)
select a, b, count(*) filter (w=a) a_wins, count(*) filter (w=b) b_wins, count(*) filter (w is null) draws, string_agg(match_id::varchar, ',' order by rn) filter (rn<=5) as last from p group by a, b""")
def a6(s, d):
    return league.head_to_head(M(s, d))


@query("a7_team_strengths", """with l as (select sum(fthg+ftag)/(2.0::double*count(*)) m, sum(fthg)/sum(fthg+ftag)::double share from matches where fthg is not null)
select team, count(*) n, round((sum(gf)+6*any_value(m))/(count(*)+6)/any_value(m),6) attack, round((sum(ga)+6*any_value(m))/(count(*)+6)/any_value(m),6) defence, round(any_value(share),6) home_share from team_rows, l where gf is not null group by team""")
def a7(s, d):
    return league.strengths(M(s, d))


EWM = """with numbered as (select *, row_number() over (partition by team order by match_date, match_id) i from team_rows),
seen as (select *, count(gf) over w ngf, count(shots) over w nsh from numbered window w as (partition by team order by i rows between unbounded preceding and 1 preceding)),
sums as (select a.match_id, a.team, a.ngf, a.nsh, """ + ", ".join(
    f"sum(b.{v}*power({1 - 2 / (n + 1)!r}::double, a.i-1-b.i)) filter (b.{v} is not null and a.i-b.i<={far})/sum(power({1 - 2 / (n + 1)!r}::double, a.i-1-b.i)) filter (b.{v} is not null and a.i-b.i<={far}) as {v}{n}" for v in ("gf", "shots") for n, far in ((3, 54), (5, 91), (10, 184))
) + """ from seen a left join numbered b on a.team=b.team and b.i between a.i-184 and a.i-1 group by a.match_id, a.team, a.ngf, a.nsh)
select match_id, team, """ + ", ".join(f"case when {c}>={max(1, n // 2)} then round({v}{n},6) end as {v}_ewm{n}" for v, c in (("gf", "ngf"), ("shots", "nsh")) for n in (3, 5, 10)) + " from sums"


@query("w2_ewm_features", EWM)
def w2(s, d):
    return features.ewm_features(rows(s, d))


@query("w1_elo", """with o as (select *, home_id//20*25+match_id%25 lg, row_number() over (partition by home_id//20*25+match_id%25 order by match_date, match_id) rn from matches),
e as (select distinct lg, 0::bigint rn, null::bigint match_id, null::double eh, null::double ea, list_transform(range(20), lambda x: 1500.0::double) st, null::int season from o union all
select lg, rn, match_id, r[home_id%20+1], r[away_id%20+1], list_transform(r, lambda x, i: x + case i-1 when home_id%20 then mv when away_id%20 then -mv else 0 end), season from (select *, case when fthg is null or ftag is null then 0 else
 20*ln(greatest(abs(fthg-ftag),1)+1)*(case when fthg>ftag then 1 when fthg=ftag then 0.5 else 0 end-1/(1+power(10::double,(r[away_id%20+1]-(r[home_id%20+1]+50))/400))) end mv
 from (select o.*, case when e.season is not null and o.season<>e.season then list_transform(e.st, lambda x: 0.67::double*x+0.33::double*1500) else e.st end r from e join o on o.lg=e.lg and o.rn=e.rn+1)))
select match_id, round(eh,6) elo_home, round(ea,6) elo_away from e where rn>0""")
def w1(s, d):
    """Each twenty clubs play twenty-five leagues, a rating of a club in each."""
    e = features.elo(M(s, d).withColumn("league", F.expr("home_id div 20 * 25 + match_id % 25")))
    return e.select("match_id", F.round("elo_home", 6).alias("elo_home"), F.round("elo_away", 6).alias("elo_away"))


@query("w3_rest_days", """select match_id, team, coalesce(least(date_diff('day', lag(match_date) over (partition by team order by match_date, match_id), match_date),30),7)::int as rest from team_rows""")
def w3(s, d):
    return features.rest_days(rows(s, d))


@query("w4_head_to_head_rates", """with p as (select *, least(home_id,away_id) a, greatest(home_id,away_id) b, case when fthg>ftag then home_id when fthg<ftag then away_id when fthg is not null then -1 end w from matches),
c as (select match_id, home_id, a, count(w) over x n, coalesce(sum((w=a)::int) over x,0) wa, coalesce(sum((w=b)::int) over x,0) wb, coalesce(sum((w=-1)::int) over x,0) dr from p window x as (partition by a, b order by match_date, match_id rows between unbounded preceding and 1 preceding))
select match_id, round((case when home_id=a then wa else wb end)/greatest(n,1),6) home_rate, round(dr/greatest(n,1),6) draw_rate, n as met from c""")
def w4(s, d):
    return features.head_to_head_rates(M(s, d))


@query("w5_form", """with r as (select *, case when gf>ga then 3 when gf=ga then 1 when gf is not null then 0 end p from team_rows),
d as (select team, row_number() over w k, sum(p) over (w rows between 4 preceding and current row) s, count(p) over (w rows between 4 preceding and current row) n from r where p is not null window w as (partition by team order by match_date, match_id)),
k as (select match_id, team, count(p) over (partition by team order by match_date, match_id rows between unbounded preceding and 1 preceding) k from r)
select match_id, k.team, round(coalesce(s/(3.0::double*n),0),6) as form from k left join d on k.team=d.team and k.k=d.k""")
def w5(s, d):
    return features.form(rows(s, d))


@query("w6_opponent_conceded", """with o as (select match_id, team, case when count(shots_against) over w>=3 then avg(shots_against) over w else 5.0::double end v from team_rows window w as (partition by team order by match_date, match_id rows between 10 preceding and 1 preceding))
select m.match_id, round(a.v,6) home_opponent_conceded, round(h.v,6) away_opponent_conceded from matches m join o h on h.match_id=m.match_id and h.team=m.home_id join o a on a.match_id=m.match_id and a.team=m.away_id""")
def w6(s, d):
    return features.conceded(rows(s, d), M(s, d))


@query("w10_time_decay", """select match_id, round(exp(-0.003::double*date_diff('day',match_date,(select max(match_date) from matches))),6) weight from matches""")
def w10(s, d):
    return features.decay(M(s, d))


@query("p9_derby", """select match_id, (least(home_id,away_id)*2+1=greatest(home_id,away_id))::int as derby from matches""")
def p9(s, d):
    pairs = s.range(10).select((F.col("id") * 2 + 1).cast("int").alias("a"), F.col("id").cast("int").alias("b"))
    return features.derby(M(s, d), pairs)


@query("p10_targets", """select match_id, fthg+ftag total_goals, (fthg>0 and ftag>0)::int btts, case when fthg>ftag then 0 when fthg=ftag then 1 else 2 end as result from matches where fthg is not null""")
def p10(s, d):
    return features.targets(M(s, d))


@query("p24_impute_median", """select match_id, coalesce(hs, (select quantile_cont(hs,0.5) from matches where season<2001))::double as hs from matches""")
def p24(s, d):
    return features.impute(M(s, d).select("match_id", "season", "hs"), "hs", F.col("season") < 2001).select("match_id", "hs")


@query("p25_temporal_split", """select match_id, case when season=(select max(season) from matches) then 'validate' else 'train' end as part from matches""")
def p25(s, d):
    return features.holdout(M(s, d))


@query("j2_team_features_both_sides", """with s as (select team, round(avg(gf),6) g from team_rows group by team)
select match_id, h.g as home_goals, a.g as away_goals from matches left join s h on h.team=home_id left join s a on a.team=away_id""")
def j2(s, d):
    teams = rows(s, d).groupBy("team").agg(F.round(F.avg("gf"), 6).alias("goals"))
    return features.both_sides(M(s, d), teams, ["goals"]).select("match_id", "home_goals", "away_goals")


@query("j3_referee_on_match", """with p as (select referee, avg(hy+ay) m from matches where hy is not null group by referee having count(*)>=3)
select match_id, round(coalesce(m,1.0),6) card_rate from matches left join p using (referee)""")
def j3(s, d):
    return features.referee_rate(M(s, d), league.referee_profiles(M(s, d)))
