"""Queries on claims under the full set of rules."""

from pyspark.sql import functions as F

from fieldglass.operators import resolution as rs
from fieldglass.sources import tables as t

from .registry import query

NOW = "2024-02-06 00:00:00"



def evidence(s, d):
    """Events as claims with a typed value: every field comes from the event's own columns."""
    e = t.table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("v", F.floor("value").cast("int"))
    kind = F.when(F.col("event_type").isin("click", "view"), "chance_of_playing").when(F.col("event_type") == "signup", "status").when(F.col("event_type") == "error", "return_date").when(F.col("v") < 170, "predicted_start").otherwise("permanent_exit")
    day = F.date_format(F.date_add(F.to_date("ts"), F.col("v") % 40), "yyyy-MM-dd")
    value = (
        F.when(kind == "chance_of_playing", F.least(F.col("v"), F.lit(130)).cast("string")).when(kind == "status", F.substring(F.lit("adisunx"), F.col("v") % 7 + 1, 1))
        .when(kind == "return_date", F.when(F.col("k") == 0, "soon").otherwise(day)).when(kind == "predicted_start", F.concat(F.lit("0."), F.lpad((F.col("v") % 100).cast("string"), 2, "0")))
        .otherwise(F.when(F.col("k") % 2 == 0, F.lit('{"kind": "loan"}')).otherwise(F.lit("{}")))
    )
    claimed = F.when(F.col("k") % 4 > 0, F.expr("ts + make_dt_interval(0, 5 - v, 0, 0)"))
    return e.select(
        F.col("event_id").alias("claim_id"), F.col("user_id").alias("player_id"), kind.alias("claim_type"), value.alias("value"), claimed.alias("claimed_at"), F.col("ts").alias("observed_at"),
        F.substring(F.md5(F.col("props").cast("binary")), 1, 1).alias("source"), (F.col("k") % 3 + 1).alias("tier"), F.when(F.col("v") >= 3, F.md5(F.col("props").cast("binary"))).alias("digest"),
    )


EVIDENCE = """ev as (select *, json_extract_string(props,'$.k')::int k, floor(value)::int v from events),
kd as (select *, case when event_type in ('click','view') then 'chance_of_playing' when event_type='signup' then 'status' when event_type='error' then 'return_date' when v<170 then 'predicted_start' else 'permanent_exit' end claim_type from ev),
evidence as (select event_id claim_id, user_id player_id, claim_type,
  case claim_type when 'chance_of_playing' then least(v,130)::varchar when 'status' then substr('adisunx', v%7+1, 1) when 'return_date' then case when k=0 then 'soon' else strftime(cast(ts as date)+v%40, '%Y-%m-%d') end when 'predicted_start' then '0.'||lpad((v%100)::varchar,2,'0') else case when k%2=0 then '{"kind": "loan"}' else '{}' end end as value,
  case when k%4>0 then ts+to_hours(5-v) end claimed_at, ts observed_at, substr(md5(props),1,1) source, k%3+1 tier, case when v>=3 then md5(props) end digest from kd)"""

RESOLVED = f"""{EVIDENCE},
good as (select *, coalesce(claimed_at, observed_at) as at_, case claim_type when 'chance_of_playing' then try_cast(value as double)/100 when 'permanent_exit' then 0 when 'unavailable_until' then 0 when 'status' then case value when 'a' then 1.0 when 'd' then 0.75 when 'i' then 0.1 when 's' then 0.1 when 'u' then 0 when 'n' then 0 end end::double as hope
  from evidence where not coalesce(claimed_at>observed_at, false) and not (tier>=2 and digest is null) and not (claim_type='chance_of_playing' and try_cast(value as double)>100) and value not in ('soon', '{{}}')),
counts as (select player_id, claim_type, count(*) filter (claim_id not in (select claim_id from good)) dropped, count(*) filter (claim_id in (select claim_id from good)) valid from evidence group by 1,2),
aged as (select *, date_diff('microsecond', at_, timestamp '{NOW}')//86400000000>21 stale from good),
pool as (select *, count(*) filter (stale) over g stales, count(*) over g n from aged window g as (partition by player_id, claim_type) qualify not stale or bool_and(stale) over g),
cont as (select * from pool qualify row_number() over (partition by player_id, claim_type, source order by at_ desc, observed_at desc, claim_id desc)=1),
led as (select *, row_number() over (partition by player_id, claim_type order by tier, at_ desc, observed_at desc, claim_id desc) r, row_number() over (partition by player_id, claim_type order by at_, observed_at, claim_id) late, count(*) over (partition by player_id, claim_type) contenders from cont),
tops as (select player_id, claim_type, claim_id tid, value tv, tier tt, hope th, late tl from led where r=1),
both_ as (select *, r>1 and tier=tt and case claim_type when 'chance_of_playing' then abs(try_cast(value as double)-try_cast(tv as double))>=25 when 'return_date' then abs(date_diff('day', try_cast(tv as date), try_cast(value as date)))>7 when 'status' then hope is null or th is null or (hope>0.5)<>(th>0.5) else value<>tv end as rival, tier>tt and late>tl and hope is not null and th is not null as below from led join (select player_id pl, claim_type ct, tid, tv, tt, th, tl from tops) on pl=player_id and ct=claim_type),
fold as (select player_id, claim_type, any_value(tid) tid, any_value(tv) tv, any_value(th) th, any_value(n) n, any_value(stales) stales, any_value(contenders) contenders, arg_max(claim_id, late) filter (rival) rid, arg_min(struct_pack(i:=claim_id, v:=value), struct_pack(h:=coalesce(hope,1.0), l:=-late)) filter (rival or r=1) ca, arg_max(struct_pack(i:=claim_id, v:=value, h:=hope), late) filter (below) ch from both_ group by 1,2),
ruled as (select *, case when n=1 then 'only_claim' when contenders=1 then case when stales>0 and stales<n then 'fresher_claim_beats_stale' else 'recency_within_source' end when rid is not null then 'unresolved_conservative' when ch.h<th then 'asymmetric_override' when ch is not null then 'asymmetric_override_refused' else 'tier_precedence' end as rule from fold),
won as (select player_id, claim_type, case rule when 'unresolved_conservative' then ca.v when 'asymmetric_override' then ch.v else tv end as value, rule, case rule when 'unresolved_conservative' then ca.i when 'asymmetric_override' then ch.i else tid end claim_id, case rule when 'unresolved_conservative' then case when ca.i=tid then rid else tid end when 'asymmetric_override' then tid when 'asymmetric_override_refused' then ch.i end against from ruled),
every_ as (select player_id, claim_type, value, coalesce(rule,'all_claims_invalid') as rule, claim_id, greatest(valid-1,0) beaten, dropped, coalesce(rule='unresolved_conservative',false) unresolved, against from counts left join won using (player_id, claim_type)),
gone as (select distinct player_id from every_ where claim_type='permanent_exit' and value is not null),
resolved as (select player_id, claim_type, case when g then '0' else value end as value, case when g then 'permanence_beats_gradation' else rule end as rule, claim_id, beaten, dropped, unresolved and not g as unresolved, case when not g then against end as against from (select *, claim_type='chance_of_playing' and player_id in (select player_id from gone) g from every_))"""


def resolved(s, d):
    return rs.resolve(evidence(s, d), F.to_timestamp_ntz(F.lit(NOW)))


@query("l5_resolution", f"with {RESOLVED} select * from resolved")
def l5_resolution(s, d):
    return resolved(s, d)


@query("l5_fates", f"with {RESOLVED} select claim_id, case when claim_id in (select claim_id from resolved where claim_id is not null) then 'used' when claim_id in (select claim_id from good) then 'beaten' when claimed_at>observed_at then 'claimed after it was observed' when tier>=2 and digest is null then 'no provenance' when value='soon' then 'not a date' when value='{{}}' then 'no kind of exit' else 'out of domain' end as fate from evidence")
def l5_fates(s, d):
    return rs.fates(evidence(s, d), resolved(s, d)).select("claim_id", "fate")


@query("l5_summary", f"with {RESOLVED} select rule, count(*) n, count(*) filter (unresolved) as unresolved, sum(dropped)::bigint as dropped, count(*) filter (rule in ('unresolved_conservative','asymmetric_override_refused')) as escalated from resolved where claim_type<>'predicted_start' group by 1")
def l5_summary(s, d):
    return rs.summary(rs.availability(resolved(s, d)))
