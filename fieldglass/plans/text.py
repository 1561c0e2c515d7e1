"""Queries on news, posts, pages and names."""

from pyspark.sql import functions as F

from fieldglass.operators import text as tx
from fieldglass.sources import tables as t

from .registry import query

PARTS = ("Knee", "Hamstring", "Illness", "Calf")


def notes(s, d):
    key = F.col("player_id")
    part = F.element_at(F.array(*map(F.lit, PARTS)), (key % 4 + 1).cast("int"))
    day = F.concat((key % 30 + 1).cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, ("Jan", "Feb", "Jun", "Nov"))), (key % 3 + 1).cast("int")))
    note = F.element_at(F.array(F.concat(part, F.lit(" injury - "), (key % 4 * 25).cast("string"), F.lit("% chance of playing")), F.concat(F.lit("Suspended until "), day), F.concat(part, F.lit(" problem - Expected back "), day), F.lit("Has joined Rovers on loan"), F.concat(part, F.lit(" injury - Unknown return date")), F.lit("Fine")), (key % 6 + 1).cast("int"))
    return t.players(s, d).select("player_id", note.alias("news"), F.lit("2024-05-20").cast("date").alias("added"))


@query("f6_f7_f21_availability_notes", """with k as (select player_id, player_id%6 c, ['knee','hamstring','illness','calf'][player_id%4+1] part, ['ligament','muscular','unspecified','muscular'][player_id%4+1] inj, player_id%30+1 dd, [1,2,6][player_id%3+1] mm from players),
b as (select *, try_cast(printf('2024-%02d-%02d', mm, dd) as date) t, try_cast(printf('2025-%02d-%02d', mm, dd) as date) u from k)
select player_id, ['chance','suspended','expected','left','unknown','none'][c+1] kind, case when c in (0,2,4) then part end part, case when c in (0,2,4) then inj end injury, case c when 0 then player_id%4*25 when 5 then null else 0 end chance,
 case when c in (1,2) then case when date_diff('day', t, date '2024-05-20')>60 then u else t end end as back from b""")
def f6(s, d):
    return tx.availability(notes(s, d)).drop("news", "added")


CLUBS = [f"Team {n}" for n in range(1, 6)]


def posts(s, d):
    n = F.col("claim_id")
    words = F.element_at(F.array(*map(F.lit, ("hamstring injury update", "use promo code now", "U21 injury news", "transfer talk", "nothing here", "benched again", "signs on loan"))), (n % 7 + 1).cast("int"))
    club = F.when(n % 5 == 0, "").when(n % 5 == 1, " Team 1 v Team 2").otherwise(F.concat(F.lit(" Team "), n % 5))
    return t.claims(s, d).select("claim_id", F.concat(words, club).alias("text"), (n % 3 == 0).alias("trusted"))


@query("p15_f9_f10_relevance", """with c as (select claim_id, claim_id%7 w, claim_id%5 b, claim_id%3=0 tr from claims) select claim_id, case when b in (0,1) then null else 'Team '||b end as club,
 case w when 1 then 'promotion' when 2 then 'out of scope' when 4 then 'no signal' else case when w in (3,6) and not tr then 'weak signal' when b in (0,1) then 'no club' else 'relevant' end end as verdict from c""")
def p15(s, d):
    return tx.relevance(posts(s, d), CLUBS).select("claim_id", "club", "verdict")


@query("p14_f8_scope", "select claim_id, claim_id%7=2 as vetoed from claims")
def p14(s, d):
    return posts(s, d).select("claim_id", tx.out_of_scope(F.col("text")).alias("vetoed"))


@query("p16_checked_feed", """with r as (select case when claim_id%11=0 then 'no id' when claim_id%13=0 then 'no time' when ts>timestamp '2024-01-25' then 'future' when claim_type='signup' then 'kind' when claim_id%6=0 then 'no quote' end reason from claims) select reason, count(*) n from r group by 1""")
def p16(s, d):
    n = F.col("claim_id")
    rows = t.claims(s, d).select(F.when(n % 11 > 0, n).alias("id"), F.when(n % 13 > 0, F.col("ts")).alias("ts"), F.col("claim_type").alias("kind"), F.when(n % 6 == 0, " a ").otherwise("said so").alias("quote"))
    return tx.checked(rows, F.lit("2024-01-25").cast("timestamp_ntz"), ["view", "click", "purchase", "error"]).groupBy("reason").agg(F.count("*").alias("n"))


LINES = r"list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ')<>'')"


@query("f11_f12_headline_and_body", f"select doc_id, md5(trim({LINES}[1], ' ')) as head, greatest(0, len({LINES})-2)::int as body_lines from documents")
def f12(s, d):
    rows = t.table(s, d, "documents")
    return rows.select("doc_id", F.md5(tx.headline(F.col("text"))).alias("head"), F.size(tx.body_lines(F.col("text"), 1, 1)).alias("body_lines"))


@query("f5_paragraphs", r"""with p as (select page_id, list_filter(list_transform(regexp_extract_all(html,'<p>((?s:.*?))</p>',1), lambda x: trim(regexp_replace(regexp_replace(x,'<[^>]*>','','g'),'[ \t\n\r]+',' ','g'),' ')), lambda x: x<>'')[1:120] l from pages) select page_id, len(l)::int as paragraphs, md5(coalesce(array_to_string(l, chr(10)),'')) as digest from p""")
def f5(s, d):
    rows = t.table(s, d, "pages").select("page_id", tx.paragraphs(F.col("html")).alias("p"))
    return rows.select("page_id", F.size("p").alias("paragraphs"), F.md5(F.array_join("p", "\n")).alias("digest"))


@query("f13_bet_labels", """with l as (select match_id, unnest(['Over 2.5','Under 3.5','Yes','No','Home']) label from matches) select match_id, label, try_cast(nullif(regexp_extract(label,'([0-9.]+)',1),'') as double) as line, case when label in ('Over 2.5','Yes') then 'goals' when label in ('Under 3.5','No') then 'no goals' else 'home' end as direction,
 case when label<>'Home' then match_id||':'||case when label in ('Over 2.5','Yes') then 'goals' else 'no goals' end end as nest from l""")
def f13(s, d):
    label = F.explode(F.array(*map(F.lit, ("Over 2.5", "Under 3.5", "Yes", "No", "Home"))))
    rows = t.matches(s, d).select("match_id", label.alias("label"))
    market, name = F.lit("goals"), F.col("label")
    return rows.select("match_id", "label", tx.bet_line(name).alias("line"), tx.bet_direction(market, name).alias("direction"), tx.nesting_key(F.col("match_id"), market, name).alias("nest"))


@query("j9_f2_same_person", """with p as (select player_id id, team_id team, case when player_id%7=0 then 'shared name' else 'player '||replace(translate(player_id::varchar,'0123456789','abcdefghij'),' ','') end full_, 'w'||translate((player_id//3)::varchar,'0123456789','abcdefghij') web, player_id from players),
f as (select full_, count(*) n, min(id) i from p group by 1), g as (select full_, team, count(*) n, min(id) i from p group by 1,2), w as (select web, count(*) n, min(id) i from p group by 1), v as (select web, team, count(*) n, min(id) i from p group by 1,2),
j as (select p.id, case when f.n=1 then f.i when g.n=1 then g.i end a, case when w.n=1 then w.i when v.n=1 then v.i end b from p join f using (full_) join g on g.full_=p.full_ and g.team=p.team join w using (web) join v on v.web=p.web and v.team=p.team)
select id as old_id, coalesce(a,b) as new_id, case when a is not null then 'full' else 'web' end as stage from j where coalesce(a,b) is not null""")
def j9(s, d):
    letters = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    key = F.col("player_id")
    full = F.when(key % 7 == 0, "Shared Name").otherwise(F.concat(F.lit("Player-"), letters(key)))
    rows = t.players(s, d).select(key.alias("id"), full.alias("full"), F.concat(F.lit("W"), letters(F.floor(key / 3))).alias("web"), F.lit("x").alias("first"), F.lit("y").alias("last"), F.col("team_id").alias("team"))
    return tx.same_person(rows, rows)
