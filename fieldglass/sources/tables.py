"""Driver tables seen as matches, prices, players, appearances and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a match: orders as fixtures of clubs of forty customers, twenty clubs a league, their lines as goals, shots and cards; no lines: unplayed."""
    line = table(spark, sf_dir, "lineitem")
    home, red = F.col("l_linestatus") == "F", F.col("l_returnflag") == "R"

    def total(when: Column, what: Column | int = 1) -> Column:
        return F.sum(F.when(when, what).otherwise(0)).cast("int")

    stats = line.groupBy(F.col("l_orderkey").alias("match_id")).agg(
        total(home).alias("fthg"), total(~home).alias("ftag"), total(home, F.col("l_quantity")).alias("hs"), total(~home, F.col("l_quantity")).alias("away_s"),
        total(home & red).alias("hy"), total(~home & red).alias("ay"),
    )
    order = table(spark, sf_dir, "orders")
    host = F.expr("cast(o_custkey div 40 as int)")
    fixtures = order.select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").cast("date").alias("match_date"), F.year("o_orderdate").alias("season"), host.alias("home_id"),
        (host - host % 20 + (host % 20 + 1 + F.col("o_orderkey") % 19) % 20).cast("int").alias("away_id"), F.concat(F.lit("REF"), (F.col("o_orderkey") % 25).cast("string")).alias("referee"),
    )
    return fixtures.join(stats, "match_id", "left")


def team_rows(played: DataFrame) -> DataFrame:
    """Two rows a match, each from one side."""

    def side(me: str, you: str, gf: str, ga: str, shots: str, against: str, cards: str, is_home: bool) -> DataFrame:
        return played.select("match_id", "match_date", "season", F.col(me).alias("team"), F.col(you).alias("opponent"), F.lit(is_home).alias("is_home"), F.col(gf).alias("gf"), F.col(ga).alias("ga"), F.col(shots).alias("shots"), F.col(against).alias("shots_against"), F.col(cards).alias("cards"))

    return side("home_id", "away_id", "fthg", "ftag", "hs", "away_s", "hy", True).unionByName(side("away_id", "home_id", "ftag", "fthg", "away_s", "hs", "ay", False))


def prices(played: DataFrame, books: int = 5) -> DataFrame:
    """Long decimal prices: match_id, book, outcome (H, D, A), price. Margins of 3 to 7 %."""
    b = F.explode(F.sequence(F.lit(0), F.lit(books - 1)))
    m = played.select("match_id", "home_id", "away_id", b.alias("book"))
    h = 1.0 + ((F.col("home_id") * 7 + F.col("match_id")) % 11) / 5.0 + ((F.col("match_id") * 7 + F.col("book") * 3) % 5) * 0.01
    a = 0.8 + ((F.col("away_id") * 5 + F.col("match_id")) % 9) / 6.0
    m = m.select("match_id", "book", h.alias("H"), F.lit(1.2).alias("D"), a.alias("A"))
    total = F.col("H") + F.col("D") + F.col("A")
    priced = m.select("match_id", "book", *[(1.0 / ((F.col(o) / total) * (1.03 + 0.01 * F.col("book")))).alias(o) for o in ("H", "D", "A")])
    return priced.unpivot(["match_id", "book"], ["H", "D", "A"], "outcome", "price")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as players of clubs of forty, each with every position."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    digit = key % 10
    position = F.element_at(F.array(*map(F.lit, ("DEF", "MID", "FWD", "GKP"))), (F.when(digit < 3, 1).when(digit < 7, 2).when(digit < 9, 3).otherwise(4)).cast("int"))
    return c.select(
        key.alias("player_id"), F.col("c_name").alias("name"), F.expr("cast(c_custkey div 40 as int)").alias("team_id"), position.alias("position"), (40 + key % 90).cast("int").alias("price"),
        (key * 37 % 3000).cast("int").alias("minutes"), (key * 13 % 17).cast("int").alias("goals"), (key * 7 % 11).cast("int").alias("assists"),
        (F.col("c_acctbal") / 1000.0).alias("xp"), F.round((key * 31 % 101) / 10.0, 2).alias("selected_by"),
        F.element_at(F.array(*map(F.lit, ("a", "a", "a", "d", "i", "s", "u", "n"))), (key % 8 + 1).cast("int")).alias("status"), F.when(key % 5 == 0, (key % 4 * 25).cast("int")).alias("chance"),
    )


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a player and round: lines of an order as what the player did."""
    line = table(spark, sf_dir, "lineitem")
    s = line.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("int").alias("q"), F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("int").alias("r"), F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).cast("int").alias("f"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("player_id"), F.col("o_orderdate").cast("date").alias("day"), F.year("o_orderdate").alias("season"), F.weekofyear("o_orderdate").alias("round"))
    j = o.join(s, o.o_orderkey == s.l_orderkey)
    digit = F.col("player_id") % 10
    position = F.element_at(F.array(*map(F.lit, ("DEF", "MID", "FWD", "GKP"))), (F.when(digit < 3, 1).when(digit < 7, 2).when(digit < 9, 3).otherwise(4)).cast("int"))
    return j.select(
        F.col("o_orderkey").alias("row_id"), "player_id", "day", "season", "round", F.expr("cast(player_id div 40 as int)").alias("team_id"), position.alias("position"), (F.col("q") % 91).cast("int").alias("minutes"), (F.col("r") % 3).cast("int").alias("goals"),
        (F.col("f") % 3).cast("int").alias("assists"), (F.col("n") % 5).cast("int").alias("conceded"), (F.col("q") % 7).cast("int").alias("saves"), (F.col("q") % 2).cast("int").alias("yellow"), (F.col("q") % 41 == 0).cast("int").alias("red"), (F.col("q") % 15).cast("int").alias("actions"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims about a player: claim_id, ts, player_id, claim_type, value, k."""
    return as_claims(table(spark, sf_dir, "events"))


def as_claims(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("claim_id"), "ts", F.col("user_id").alias("player_id"), F.col("event_type").alias("claim_type"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as forecasts of quality: key, p, y, round."""
    p = (F.col("doc_id") * 7919 % 1000) / 1000.0
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, F.greatest(p, F.lit(0.4))).otherwise(p).alias("p"), F.col("quality").alias("y"), (F.col("doc_id") % 12).cast("int").alias("round"))


#: The same views for an independent engine, by name; each may use those before it.
SQL = {
    "matches": """select o_orderkey as match_id, cast(o_orderdate as date) as match_date, cast(year(o_orderdate) as int) as season, (o_custkey//40)::int as home_id,
  (o_custkey//40 - o_custkey//40%20 + (o_custkey//40%20 + 1 + o_orderkey%19)%20)::int as away_id, 'REF' || (o_orderkey % 25) as referee, f::int as fthg, o::int as ftag, qf::int as hs, qo::int as away_s, rf::int as hy, ro::int as ay
  from orders left join (select l_orderkey, sum((l_linestatus='F')::int) as f, sum((l_linestatus='O')::int) as o, sum(case when l_linestatus='F' then l_quantity else 0 end) as qf, sum(case when l_linestatus='O' then l_quantity else 0 end) as qo,
  sum((l_returnflag='R' and l_linestatus='F')::int) as rf, sum((l_returnflag='R' and l_linestatus='O')::int) as ro from lineitem group by l_orderkey) on l_orderkey = o_orderkey""",
    "team_rows": """select match_id, match_date, season, home_id as team, away_id as opponent, true as is_home, fthg as gf, ftag as ga, hs as shots, away_s as shots_against, hy as cards from matches
  union all select match_id, match_date, season, away_id, home_id, false, ftag, fthg, away_s, hs, ay from matches""",
    "wide_prices": """select match_id, b as book, 1.0::double + ((home_id*7+match_id)%11)/5.0::double + ((match_id*7+b*3)%5)*0.01::double as wh, 1.2::double as wd, 0.8::double + ((away_id*5+match_id)%9)/6.0::double as wa from matches, range(5) t(b)""",
    "prices": """select match_id, book, o as outcome, 1.0::double/((w/(wh+wd+wa))*(1.03::double+0.01::double*book)) as price from (select *, unnest(['H','D','A']) as o, unnest([wh,wd,wa]) as w from wide_prices)""",
    "players": """select c_custkey as player_id, c_name as name, (c_custkey//40)::int as team_id, case when c_custkey%10<3 then 'DEF' when c_custkey%10<7 then 'MID' when c_custkey%10<9 then 'FWD' else 'GKP' end as position, (40+c_custkey%90)::int as price,
  (c_custkey*37%3000)::int as minutes, (c_custkey*13%17)::int as goals, (c_custkey*7%11)::int as assists, c_acctbal/1000.0::double as xp, round((c_custkey*31%101)/10.0::double,2) as selected_by,
  (['a','a','a','d','i','s','u','n'])[c_custkey%8+1] as status, case when c_custkey%5=0 then (c_custkey%4*25)::int end as chance from customer""",
    "appearances": """select o_orderkey as row_id, o_custkey as player_id, cast(o_orderdate as date) as day, cast(year(o_orderdate) as int) as season, cast(week(o_orderdate) as int) as round, (o_custkey//40)::int as team_id,
  case when o_custkey%10<3 then 'DEF' when o_custkey%10<7 then 'MID' when o_custkey%10<9 then 'FWD' else 'GKP' end as position, (q%91)::int as minutes, (r%3)::int as goals, (f%3)::int as assists, (n%5)::int as conceded, (q%7)::int as saves, (q%2)::int as yellow, (q%41=0)::int as red, (q%15)::int as actions
  from orders join (select l_orderkey, count(*) n, sum(l_quantity)::int q, sum((l_returnflag='R')::int)::int r, sum((l_linestatus='F')::int)::int f from lineitem group by 1) on l_orderkey=o_orderkey""",
    "claims": """select event_id as claim_id, ts, user_id as player_id, event_type as claim_type, value, (json_extract_string(props,'$.k'))::int as k from events""",
    "forecasts": """select doc_id as key, case when quality=1 then greatest((doc_id*7919%1000)/1000.0::double, 0.4::double) else (doc_id*7919%1000)/1000.0::double end as p, quality as y, (doc_id%12)::int as round from labels""",
}


def with_views(sql: str) -> str:
    """The SQL after the definitions of the views."""
    return "with recursive " + ",\n".join(f"{k} as ({v})" for k, v in SQL.items()) + (",\n" + sql.removeprefix("with ").removeprefix("recursive ") if sql.startswith("with ") else "\n" + sql)
