"""Queries on who the documents are about: names and clubs are words of the benchmark's items."""

from pyspark.sql import functions as F

from fieldglass.operators import linking as lk
from fieldglass.operators.simulation import spread
from fieldglass.sources import tables as t
from fieldglass.sources.scratch import stored

from .registry import query


def known(s, d):
    """Players by the third to fourth or fifth word of each item, their clubs by its first word, minutes by its length."""
    w = t.table(s, d, "benchmark").select("item_id", lk.words(F.col("text")).alias("w"), (F.length("text") % 91).alias("minutes")).where("size(w) >= 5")
    return w.select(F.array_join(F.slice("w", F.lit(3), 2 + F.length(F.col("w")[2]) % 2), " ").alias("name"), F.col("item_id").cast("string").alias("entity"), F.lower(F.col("w")[0]).alias("club"), "minutes")


def found(s, d):
    players, docs = known(s, d), t.table(s, d, "documents").select("doc_id", "text")
    names = players.select("name", F.lit("player").alias("kind"), "entity").unionByName(players.select(F.col("club").alias("name"), F.lit("club").alias("kind"), F.col("club").alias("entity")).distinct())
    return docs, players, lk.mentions(docs, names, "doc_id", "text")


KNOWN = r"""item as (select item_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+') w, length(text)%91 as minutes from benchmark),
pl as (select array_to_string(w[3:4+length(w[3])%2], ' ') as name, item_id::varchar entity, lower(w[1]) club, minutes from item where len(w)>=5),
nm as (select name, 'player|'||entity as of_ from pl union all select distinct club, 'club|'||club from pl),
dict as (select replace(lower(strip_accents(name)),'ß','ss') k, len(string_split(name, ' ')) n, min(of_) of_, min(of_)<>max(of_) ambiguous from nm group by 1,2),
tok as (select doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+') w from documents),
spot as (select doc_id, w, unnest(range(1, len(w)+1)) s from tok),
gram as (select doc_id, s, n, replace(lower(strip_accents(array_to_string(w[s:s+n-1], ' '))),'ß','ss') k from spot, (select distinct n from dict) where s+n-1<=len(w)),
hit as materialized (select doc_id, s, n, of_, ambiguous from gram join dict using (k, n)),
mb as (select * from hit qualify row_number() over (partition by doc_id, s order by n desc)=1),
listed as (select doc_id, list([struct_pack(s:=s, e:=s+n)] order by s) l from mb group by 1),
pick as (select doc_id, unnest(list_reduce(l, lambda a, x: case when x[1].s>=a[-1].e then list_concat(a, x) else a end)).s s from listed),
men as (select doc_id, s, n, split_part(of_,'|',1) kind, split_part(of_,'|',2) entity, ambiguous from mb join pick using (doc_id, s)),
sure as (select distinct doc_id, kind, entity from men where not ambiguous),
link as (select s.doc_id, s.entity, c.entity club from sure s join pl on pl.entity=s.entity and s.kind='player' join sure c on c.doc_id=s.doc_id and c.kind='club' and c.entity=pl.club)"""


@query("j11_linked_texts", f"with {KNOWN} select * from link")
def j11(s, d):
    _, players, m = found(s, d)
    return lk.linked(m, players, "doc_id")


@query("j11_mentions", f"with {KNOWN} select doc_id, s-1 as start, n, kind, entity, ambiguous from men")
def j11_mentions(s, d):
    return found(s, d)[2]


@query("j11_standing", f"""with {KNOWN}, sd as (select doc_id, count(distinct entity) filter (kind='club' and not ambiguous) clubs, count(*) filter (ambiguous) refused from men group by 1), wh as (select doc_id, count(*) linked from link group by 1)
select doc_id, coalesce(clubs,0) clubs, coalesce(linked,0) linked, coalesce(refused,0) refused, case when linked>0 then 'player' when clubs>0 then 'club' else 'none' end as level from documents left join sd using (doc_id) left join wh using (doc_id)""")
def j11_standing(s, d):
    docs, players, m = found(s, d)
    m = stored(m, "mentions")  # read for the links and for the counts
    return lk.standing(docs, m, lk.linked(m, players, "doc_id"), "doc_id")


@query("j12_conflicts", f"""with {KNOWN}, j as (select link.doc_id, entity, minutes, regexp_matches(lower(text), '{"|".join(lk.DOUBT)}') doubt from link join pl using (entity) join documents using (doc_id))
select doc_id, entity, case when minutes<45 then 'fringe_but_discussed' else 'sure_but_doubted' end kind, case when minutes<45 then 45.0-minutes else minutes-75.0 end::double gap from j where minutes<45 or (minutes>75 and doubt)""")
def j12(s, d):
    docs, players, m = found(s, d)
    return lk.conflicts(lk.linked(m, players, "doc_id"), docs, players, "doc_id", "text")


@query("f1_fold", r"select lang, count(distinct lower(w)) as spelt, count(distinct replace(lower(strip_accents(w)),'ß','ss')) as keys from (select lang, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+')) w from documents) group by 1")
def f1(s, d):
    """Different words of each language, by their letters and by the key that ignores case and accents."""
    docs = spread(t.table(s, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    # each spelling once: only those get a key
    w = docs.select("lang", F.explode(F.array_distinct(lk.words(F.col("text")))).alias("w")).distinct()
    return w.select("lang", F.lower("w").alias("spelt"), lk.key(F.col("w")).alias("key")).groupBy("lang").agg(F.count_distinct("spelt").alias("spelt"), F.count_distinct("key").alias("keys"))
