"""Queries that run a stream over the events to its end. Windows still open at the last watermark give no row."""

from pyspark.sql import functions as F

from fieldglass.sources.scratch import scratch
from fieldglass.streaming import feeds, logs

from .registry import query


def claims(s, d):
    return logs.claims(s, f"{d}/events.parquet")


@query("l2_stream_unseen", "select claim_id from claims")
def l2(s, d):
    return logs.replay(logs.unseen(claims(s, d).unionByName(claims(s, d)), "claim_id", "ts").select("claim_id"), "l2_stream_unseen")


@query("l10_stream_daily", "select player_id, cast(ts as date) as day, round(sum(value),6) used from claims group by 1,2 having cast(ts as date)+interval 1 day<=(select max(ts)-interval 2 hour from claims)")
def l10(s, d):
    return logs.replay(logs.daily(claims(s, d), "player_id", "ts", "value"), "l10_stream_daily").withColumn("used", F.round("used", 6))


@query("l_stream_sessions", """with g as (select *, (coalesce(ts-lag(ts) over (partition by player_id order by ts)>=interval 6 hour,true))::int b from claims), k as (select *, sum(b) over (partition by player_id order by ts) s from g)
select player_id, min(ts) as start, count(*) n from k group by player_id, s having max(ts)+interval 6 hour<=(select max(ts)-interval 2 hour from claims)""")
def sessions(s, d):
    return logs.replay(logs.sessions(claims(s, d), "player_id", "ts", "6 hours"), "l_stream_sessions").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("l1_k2_stream_changes", "select claim_id from (select *, lag(k%5%3) over w b, row_number() over w n from claims window w as (partition by player_id order by ts, claim_id)) where n=1 or k%5%3 is distinct from b")
def l1(s, d):
    rows = claims(s, d).select("claim_id", "player_id", "ts", (F.col("k") % 5 % 3).alias("tier"))
    return logs.changes(rows, "player_id", "tier", ["ts", "claim_id"], scratch(s, "l1_k2_stream_changes")).select("claim_id")


@query("l9_stream_feeds", """with p as (select player_id::varchar feed, epoch_us(ts) us, epoch_us(ts)//1000 at_, claim_id, claim_type, row_number() over (partition by player_id order by ts, claim_id) n from claims),
mark as (select epoch_us(max(ts))//1000-7200000 m from claims),
ready as (select * from p, mark where at_<m),
fold as (
  select feed, 1::bigint n, at_, claim_id, case when claim_type='error' then 'failed' else 'fetched' end as status, at_ attempt, (claim_type='error')::int failures, case when claim_type='error' then -1 else at_ end success, false told, null::bigint silent, 0 silent_failures from ready where n=1
  union all
  select feed, n, at_, claim_id, case when skip then 'skipped_interval' when claim_type='error' then 'failed' else 'fetched' end, case when skip then attempt else at_ end, case when skip then failures when claim_type='error' then failures+1 else 0 end, case when skip or claim_type='error' then success else at_ end,
    case when skip or claim_type='error' then told or due is not null else false end, due, failures
  from (select r.feed, r.n, r.at_, r.claim_id, r.claim_type, f.attempt, f.failures, f.success, f.told, r.at_-f.attempt<21600000 skip, case when f.success>=0 and not f.told and f.success+86400000<=r.at_ then f.success+86400000 end due from fold f join ready r on r.feed=f.feed and r.n=f.n+1)),
ends as (select feed, success+86400000 due, failures from fold, mark qualify n=max(n) over (partition by feed) and success>=0 and not told and success+86400000<m)
select feed, at_ as at_ms, claim_id as poll_id, status, failures, status='failed' and failures>=2 as escalate from fold
union all select feed, silent, null, 'silent', silent_failures, true from fold where silent is not null
union all select feed, due, null, 'silent', failures, true from ends""")
def l9_stream_feeds(s, d):
    """Events as polls of as many feeds as users: six hours between attempts, two failures are told, a day without success is silence."""
    polls = claims(s, d).select(F.col("player_id").cast("string").alias("feed"), F.col("ts").alias("at"), F.col("claim_id").alias("poll_id"), F.when(F.col("claim_type") == "error", "failed").otherwise("fetched").alias("outcome"))
    rules = feeds.Rules(interval=6 * 3_600_000, escalate=2, silent=86_400_000)
    out = feeds.replay(feeds.outcomes(polls, rules), scratch(s, "l9_stream_feeds"))
    return out.select("feed", F.unix_millis("at").alias("at_ms"), "poll_id", "status", "failures", "escalate")
