"""Queries on published tables' contracts and on availability notes."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fieldglass.operators import contracts as ct, notes as nt
from fieldglass.sources import tables as t

from .registry import query
from .value import chances


@query("e20_table_contracts", """with u as (select 'order id once' as rule, (select count(*) from (select o_orderkey from orders group by 1 having count(*)>1)) n union all select 'line once', (select count(*) from (select l_orderkey, l_linenumber from lineitem group by 1,2 having count(*)>1))
union all select 'line of an order', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders)) union all select 'line of a part', (select count(*) from lineitem where l_partkey not in (select p_partkey from part)) union all select 'order of a customer', (select count(*) from orders where o_custkey not in (select c_custkey from customer)) union all select 'label of a document', (select count(*) from labels where doc_id not in (select doc_id from documents))
union all select 'quantity in range', count(*) filter (not l_quantity between 1 and 49) from lineitem union all select 'tax below discount', count(*) filter (not l_tax<=l_discount) from lineitem) select rule, n from u""")
def e20_tables(s, d):
    at = lambda n: t.table(s, d, n)
    line, orders = at("lineitem"), at("orders")
    checks = [
        ct.unique(orders, ["o_orderkey"], "order id once"), ct.unique(line, ["l_orderkey", "l_linenumber"], "line once"), ct.refers(line, "l_orderkey", orders, "o_orderkey", "line of an order"),
        ct.refers(line, "l_partkey", at("part"), "p_partkey", "line of a part"), ct.refers(orders, "o_custkey", at("customer"), "c_custkey", "order of a customer"), ct.refers(at("labels"), "doc_id", at("documents"), "doc_id", "label of a document"),
        ct.holds(line, {"quantity in range": F.col("l_quantity").between(1, 49), "tax below discount": F.col("l_tax") <= F.col("l_discount")}),
    ]
    return reduce(DataFrame.unionByName, checks)


@query("e20_chance_contracts", "select * from (values ('chances add up', 0), ('goals fall along the lines', 0)) v(rule, n) where exists (select 1 from matches)")
def e20_chances(s, d):
    """Our chances keep their contract, whatever the tables: no breach of either rule."""
    c = chances(s, d)
    over = c.where("market = 'over_under' and outcome = 'over'")
    return ct.adds_up(c, ["match_id", "market", "line"], "p", "chances add up").unionByName(ct.falls(over, ["match_id"], "line", "p", "goals fall along the lines"))


NOTE = """nt as (select l_orderkey, l_linenumber, l_partkey, l_shipdate, case l_linenumber when 1 then pt||' injury - Expected back '||dd||' '||mo||dot when 2 then pt||' injury - '||q||'% chance of playing'||dot when 3 then pt||' Injury - Unknown return date' when 4 then 'Suspended until '||dd||' '||mo when 5 then 'Has joined '||sup||case l_returnflag when 'R' then ' on loan until the end' when 'A' then ' permanently.' else ' as a coach' end when 6 then 'Has returned to '||sup||dot else case l_returnflag when 'R' then 'Has departed the club as a free agent.' when 'A' then '' else sup||' injury' end end as news
from (select *, case l_partkey%4 when 0 then 'Knee' when 1 then 'Left hamstring' when 2 then 'Illness and calf' else 'Foot' end pt, (l_quantity::int)%31+1 dd, strftime(l_shipdate,'%b') mo, l_quantity::int*3 q, 'Supplier '||l_suppkey sup, case when l_linestatus='F' then '.' else '' end dot from lineitem))"""


def line_notes(s, d):
    """Lines as notes of eight kinds and of none, by their own numbers, dates and flags."""
    q = F.col("l_quantity").cast("int")
    part = F.element_at(F.array(*map(F.lit, ("Knee", "Left hamstring", "Illness and calf", "Foot"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    day, club, dot = F.concat_ws(" ", (q % 31 + 1).cast("string"), F.date_format("l_shipdate", "MMM")), F.concat(F.lit("Supplier "), "l_suppkey"), F.when(F.col("l_linestatus") == "F", ".").otherwise("")
    flag = lambda r, a, n: F.when(F.col("l_returnflag") == "R", r).when(F.col("l_returnflag") == "A", a).otherwise(n)
    kinds = [
        F.concat(part, F.lit(" injury - Expected back "), day, dot), F.concat(part, F.lit(" injury - "), q * 3, F.lit("% chance of playing"), dot), F.concat(part, F.lit(" Injury - Unknown return date")), F.concat(F.lit("Suspended until "), day),
        F.concat(F.lit("Has joined "), club, flag(F.lit(" on loan until the end"), F.lit(" permanently."), F.lit(" as a coach"))), F.concat(F.lit("Has returned to "), club, dot),
    ]
    text = flag(F.lit("Has departed the club as a free agent."), F.lit(""), F.concat(club, F.lit(" injury")))
    for k, c in reversed(list(enumerate(kinds, 1))):
        text = F.when(F.col("l_linenumber") == k, c).otherwise(text)
    return t.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("news"), F.to_date("l_shipdate").alias("added"))


@query("f6_notes", f"""with {NOTE}, e as (select *, regexp_extract(news, '(?i)^(.+?)\\s+injury\\s*-\\s*(?:expected back|[0-9]+%|unknown)', 1) part, regexp_extract(news, '(?i)(?:back|until) ([0-9]+) ([a-z]+)\\.?$', 1) dd, lower(regexp_extract(news, '(?i)(?:back|until) ([0-9]+) ([a-z]+)\\.?$', 2)) mo from nt),
m as (select *, list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], mo) mi from e),
t as (select *, try_cast(printf('%04d-%02d-%02d', year(l_shipdate), mi, try_cast(dd as int)) as date) a, try_cast(printf('%04d-%02d-%02d', year(l_shipdate)+1, mi, try_cast(dd as int)) as date) b from m),
w as (select *, case when date_diff('day', a, l_shipdate::date)>60 then b else a end w from t)
select l_orderkey, l_linenumber, l_partkey, case when news ilike '%expected back%' then 'injury_dated' when news ilike '%chance of playing%' then 'injury_chance' when news ilike '%unknown return%' then 'injury_undated' when news like 'Suspended%' then 'suspended_until' when news like '%on loan%' then 'loan_out' when news like '%permanently%' then 'transfer_out' when news like 'Has returned%' then 'returned_to' when news like 'Has departed%' then 'free_agent' end as pattern,
nullif(lower(part),'') as part, case when part='' then null when lower(part) like '%hamstring%' or lower(part) like '%calf%' then 'muscular' when lower(part)='knee' then 'ligament' else 'unspecified' end as injury, try_cast(nullif(regexp_extract(news, '([0-9]+)%', 1),'') as int) as chance, case when news ilike '%expected back%' then w end as back, case when news like 'Suspended%' then w end as until,
case when news like '%on loan%' then 'loan' when news like '%permanently%' or news like 'Has returned%' then 'transfer' when news like 'Has departed%' then 'free_agent' end as exit, nullif(regexp_extract(news, '^Has (?:joined|returned to) (Supplier [0-9]+)(?: on loan.*| permanently\\.|\\.?)$', 1),'') as club, case when news like '% as a coach' or news like 'Supplier%' then news end as residual from w""".replace("\\\\", "\\"))
def f6_notes(s, d):
    return nt.parsed(line_notes(s, d)).drop("news", "added")
