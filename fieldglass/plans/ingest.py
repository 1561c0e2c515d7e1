"""Queries that write files as they arrive, read them back and clean them."""

from pyspark.sql import functions as F

from fieldglass.operators import cleaning as cl, ledgers, logs
from fieldglass.sources import files, tables as t
from fieldglass.sources.scratch import scratch

from .registry import query

BOOKS = ("BA", "BB", "BC")


def raw(s, d):
    """Matches as season files have them: two date formats, null tokens, bad numbers, aliases, prices of 1."""
    m = t.matches(s, d)
    day = F.when(F.col("match_id") % 2 == 0, F.date_format("match_date", "dd/MM/yyyy")).otherwise(F.date_format("match_date", "dd/MM/yy"))
    team = lambda c: F.concat(F.when(F.col("match_id") % 7 == 0, "  ").otherwise(""), F.lit("Team "), F.col(c).cast("string"))
    ref = F.when(F.col("match_id") % 5 == 0, "NA").when(F.col("match_id") % 5 == 1, F.concat(F.lit(" "), F.lower("referee"))).otherwise(F.col("referee"))
    goals = F.when(F.col("match_id") % 13 == 0, "").when(F.col("match_id") % 17 == 0, "x").otherwise(F.col("fthg").cast("string"))
    price = lambda b, o: F.when(F.col("match_id") % (6 + b) == 0, "1.0").when(F.col("match_id") % (10 + b) == o, "").otherwise(F.round(1.5 + (F.col("match_id") * (7 + b) + o) % 40 / 10, 2).cast("string"))
    prices = [price(b, o).alias(f"{book}{side}") for b, book in enumerate(BOOKS[:2]) for o, side in enumerate("HDA")]
    return m.select("season", day.alias("Date"), team("home_id").alias("HomeTeam"), team("away_id").alias("AwayTeam"), goals.alias("FTHG"), F.col("ftag").cast("string").alias("FTAG"), F.when(F.col("match_id") % 11 == 0, "n/a").otherwise(F.col("hs").cast("string")).alias("HS"), ref.alias("Referee"), *prices)


def seasons(s, d, strict=False):
    """Each season in a file of its own; the first ones lack shots and the second book."""
    rows, path = raw(s, d), scratch(s, "seasons")
    old = rows.where("season < 1997").drop("HS", *[f"BB{o}" for o in "HDA"])
    for part in (old, rows.where("season >= 1997")):
        part.write.mode("append").partitionBy("season").csv(path, header=True, compression="gzip", encoding="ISO-8859-1")
    years = range(1995, 2002) if strict else range(1990, 2002)
    return files.read_seasons(s, {str(y): f"{path}/season={y}" for y in years}, strict)


RAW = """raw as (select *, 'Team '||home_id h, 'Team '||away_id a, strftime(match_date,'%Y%m%d')||'_Team_'||home_id||'_Team_'||away_id as match_key,
 case when match_id%13=0 or match_id%17=0 then null else fthg end g, case match_id%5 when 0 then null else 'Ref'||(match_id%25) end ref, case when match_id%11=0 or season<1997 then null else hs end shots from matches)"""


@query("s1_s2_p1_clean_matches", f"with {RAW} select match_key, season::varchar season_code, match_date, h home, a away, g fthg, ftag, shots hs, ref referee from raw where g is not null and ftag is not null")
def p1(s, d):
    return cl.clean_matches(seasons(s, d))


@query("p2_match_dates", "select match_id, match_date as day from matches")
def p2(s, d):
    m = t.matches(s, d)
    raw_day = F.when(F.col("match_id") % 3 == 0, F.date_format("match_date", "dd/MM/yyyy")).otherwise(F.date_format("match_date", "dd/MM/yy"))
    return m.select("match_id", cl.match_date(raw_day).alias("day"))


PRICE = "case when match_id%{m}=0 then null when match_id%{n}={o} then null {old} else round(1.5::double+(match_id*{k}+{o})%40/10.0::double,2) end"
WIDE = ", ".join(PRICE.format(m=6 + b, n=10 + b, o=o, k=7 + b, old="when season<1997 then null" if b else "") + f" {book}{side}" for b, book in enumerate(BOOKS[:2]) for o, side in enumerate("HDA"))
WIDE += ", " + ", ".join(f"null::double BC{o}" for o in "HDA")


@query("s3_p3_closing_prices", f"with {RAW} select match_key, {WIDE} from raw")
def p3(s, d):
    return cl.closing_prices(seasons(s, d, strict=True), BOOKS)


@query("p4_closing_market", f"""with {RAW}, w as (select match_key, {WIDE} from raw), l as (select match_key, 'BA' book, BAH h, BAD d, BAA a from w union all select match_key, 'BB', BBH, BBD, BBA from w),
k as (select * from l where h is not null and d is not null and a is not null) select match_key, book, 'H' outcome, h price from k union all select match_key, book, 'D', d from k union all select match_key, book, 'A', a from k""")
def p4(s, d):
    return cl.closing_market(p3(s, d), BOOKS)


def events(s, d):
    """Matches as nested events of three books, written as JSON lines and read back."""
    m, path = t.matches(s, d), scratch(s, "events")
    key = F.col("match_id")
    one = lambda name, price, point=None: F.struct(name.alias("name"), F.lit(point).cast("double").alias("point"), price.alias("price"))
    home, away = F.concat(F.lit("Team "), F.col("home_id")), F.concat(F.lit("Team "), F.col("away_id"))

    def book(b):
        sides = [one(home, 1.5 + (key * 7 + b * 3) % 20 / 10), one(away, 2.0 + (key * 3 + b) % 15 / 10)]
        h2h = F.when((F.lit(b) == 2) & (key % 4 == 0), F.array(*sides)).otherwise(F.array(*sides, one(F.lit("Draw"), 3.0 + (key + b) % 5 / 10)))
        totals = [one(F.lit(name), base + (key + m_ * b) % n / 20, line) for line in (2.5, 3.5) for name, base, m_, n in (("Over", 1.8, 1, 7), ("Under", 0.9, 2, 5))]
        return F.struct(F.lit(f"book{b}").alias("key"), F.array(F.struct(F.lit("h2h").alias("key"), h2h.alias("outcomes")), F.struct(F.lit("totals").alias("key"), F.array(*totals).alias("outcomes"))).alias("markets"))

    m.select(key.alias("id"), home.alias("home_team"), away.alias("away_team"), F.array(*map(book, range(3))).alias("bookmakers")).write.json(path)
    return files.read_lines(s, path, cl.EVENT)


QUOTED = "q as (select match_id id, b, 1.5::double+(match_id*7+b*3)%20/10.0::double h, case when b=2 and match_id%4=0 then null else 3.0::double+(match_id+b)%5/10.0::double end d, 2.0::double+(match_id*3+b)%15/10.0::double a from matches, range(3) t(b))"


@query("s10_p5_head_to_head", f"with {QUOTED} select id, 'book'||b book, o outcome, round(p,6) price from (select id, b, unnest(['H','D','A']) o, unnest([h,d,a]) p from q where d is not null)")
def p5(s, d):
    return cl.head_to_head(cl.quotes(events(s, d))).withColumn("price", F.round("price", 6))


@query("a19_best_totals", """with q as (select match_id id, b, l line, 1.8::double+(match_id+b)%7/20.0::double o, 0.9::double+(match_id+2*b)%5/20.0::double u from matches, range(3) t(b), (values (2.5::double),(3.5::double)) v(l)),
s as (select id, line, 'over' side, o price, b from q union all select id, line, 'under', u, b from q where u>1)
select id, line, side, round(max(price),6) price, 'book'||(arg_min(b, struct_pack(p:=-price, b:=b))) as book from s group by id, line, side""")
def a19(s, d):
    return cl.best_totals(cl.quotes(events(s, d))).withColumn("price", F.round("price", 6))


@query("f62_flat_markets", "select match_id, m market, p from (select match_id, unnest(['over_2.5','btts','home']) m, unnest([round((match_id%10)/10.0::double,6), round((match_id%7)/7.0::double,6), round((match_id%3)/3.0::double,6)]) p from matches)")
def f62(s, d):
    share = lambda n: F.round(F.col("match_id") % n / F.lit(float(n)), 6)
    nested = F.create_map(F.lit("over_2.5"), share(10), F.lit("btts"), share(7), F.lit("home"), share(3))
    path = scratch(s, "markets")
    t.matches(s, d).select("match_id", nested.alias("markets")).write.json(path)
    return cl.flat_markets(files.read_lines(s, path, "match_id long, markets map<string,double>"))


def log_lines(s, d):
    """Claims as JSON lines; every 50th line is cut short."""
    path = scratch(s, "log")
    line = F.to_json(F.struct("claim_id", "player_id", "claim_type", F.round("value", 3).alias("value")))
    t.claims(s, d).select(F.when(F.col("claim_id") % 50 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return path


LINE = "claim_id long, player_id long, claim_type string, value double"


@query("s11_drop_malformed", "select claim_id, player_id, claim_type, round(value,3) as value from claims where claim_id%50<>0")
def s11(s, d):
    return files.read_lines(s, log_lines(s, d), LINE, "drop")


@query("v7_k12_quarantine", "select count(*) filter (claim_id%50<>0) as good, count(*) filter (claim_id%50=0) as bad from claims")
def v7(s, d):
    rows, path = files.read_lines(s, log_lines(s, d), LINE, "keep"), scratch(s, "bad")
    good = files.quarantine(rows, F.col("_bad").isNotNull(), path)
    return good.agg(F.count("claim_id").alias("good")).crossJoin(s.read.json(path).agg(F.count("*").alias("bad")))


@query("s12_sealed_log", "select season*100+round as gw, player_id, sum(goals)::bigint as points from appearances group by 1,2")
def s12(s, d):
    rows = t.appearances(s, d).withColumn("round", F.col("season") * 100 + F.col("round")).groupBy("round", "player_id").agg(F.sum("goals").alias("points"))
    path = scratch(s, "sealed")
    body = rows.select(F.to_json(F.struct(F.lit("row").alias("record"), F.col("round").alias("gw"), "player_id", "points")).alias("value"))
    head = rows.select("round").distinct().select(F.to_json(F.struct(F.lit("header").alias("record"), F.col("round").alias("gw"), F.lit(True).alias("sealed"))).alias("value"))
    head.unionByName(body).write.text(path)
    header, found = files.read_sealed(s, path, "gw int, sealed boolean", "gw int, player_id long, points long")
    return found.join(header.where("sealed").select("gw"), "gw", "left_semi")


@query("s8_s9_season_archive", "select season, count(*) n, sum(minutes)::bigint as minutes from appearances group by season")
def s8(s, d):
    path = scratch(s, "archive")
    t.appearances(s, d).select("season", "row_id", "minutes").write.partitionBy("season").csv(path, header=True, compression="gzip")
    rows = s.read.csv(path, header=True, schema="row_id long, minutes int, season int")
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.sum("minutes").alias("minutes"))


@query("s5_p6_player_stats", """select player_id, 'Club '||team_id club, position, case when minutes>0 then round(goals*90.0::double/minutes,6) end goals_per_90, status in ('a','d') as available from players where status<>'u'""")
def p6(s, d):
    """The feed as one document of elements, clubs and positions."""
    p, path = t.players(s, d), scratch(s, "bootstrap")
    p.select("player_id", "team_id", "position", "minutes", "goals", "status").write.json(f"{path}/elements")
    p.select("team_id", F.concat(F.lit("Club "), "team_id").alias("club")).distinct().write.json(f"{path}/teams")
    elements = files.read_lines(s, f"{path}/elements", "player_id long, team_id int, position string, minutes int, goals int, status string")
    clubs = files.read_lines(s, f"{path}/teams", "team_id int, club string")
    return ledgers.player_stats(elements, clubs)


@query("s20_quoted_csv", "select player_id, 'He said \"'||name||'\", then left' as note from players")
def s20(s, d):
    path = scratch(s, "quoted")
    t.players(s, d).select("player_id", F.concat(F.lit('He said "'), "name", F.lit('", then left')).alias("note")).write.csv(path, header=True, escape='"', quoteAll=True)
    return files.read_csv(s, path, "UTF-8", line_breaks=True).select(F.col("player_id").cast("long").alias("player_id"), "note")


@query("k1_k8_table_export", "select team, sum(gf)::bigint as gf from team_rows where gf is not null group by team")
def k8(s, d):
    path, rows = scratch(s, "table"), t.team_rows(t.matches(s, d)).where("gf is not null").groupBy("team").agg(F.sum("gf").alias("gf"))
    for _ in range(2):  # replaced as a whole
        files.write_one(rows, path)
    return s.read.schema("team int, gf long").json(path)


@query("k7_bets_export", "select match_id, book, outcome, round(price,4) as price from prices where price>3")
def k7(s, d):
    path = scratch(s, "bets")
    t.prices(t.matches(s, d)).where("price > 3").select("match_id", "book", "outcome", F.round("price", 4).alias("price")).write.csv(path, header=True)
    return s.read.csv(path, header=True, schema="match_id long, book int, outcome string, price double")


@query("k3_append_unseen", "select claim_id, value from claims")
def k3(s, d):
    """Two overlapping batches, the second twice."""
    path, c = scratch(s, "evidence"), t.claims(s, d).select("claim_id", "value", F.to_date("ts").alias("day"))
    for part in (c.where("day < date'2024-01-20'"), c, c):
        files.append_unseen(part, path, "claim_id", "day")
    return s.read.schema("claim_id long, value double").parquet(path).select("claim_id", "value")


@query("k4_l3_sealed_once", "select claim_id from claims where ts<timestamp '2024-01-15'")
def k4(s, d):
    """What is still before its deadline is sealed; handing over the rest too would be an error."""
    path, c = scratch(s, "seal"), t.claims(s, d).select("claim_id", "ts")
    deadline = F.lit("2024-01-15").cast("timestamp_ntz")
    files.seal(c.where(F.col("ts") < deadline), path, F.col("ts"), deadline)
    return s.read.parquet(path).select("claim_id")


@query("k9_l15_pruned", "select distinct season, round from appearances where season in (select distinct season from appearances order by season desc limit 2)")
def k9(s, d):
    return files.keep_last(t.appearances(s, d).select("season", "round"), "season", 2).distinct()


@query("k6_inbox", "select url, claimed_at, claim_id from (select *, row_number() over (partition by url, claimed_at order by claim_id) n from (select claim_id, 'http://x/'||(k%20) url, cast(ts as date) claimed_at from claims)) where n=1")
def k6(s, d):
    rows = t.claims(s, d).select("claim_id", F.concat(F.lit("http://x/"), F.col("k") % 20).alias("url"), F.to_date("ts").alias("claimed_at"))
    kept, path = logs.latest(rows, ["url", "claimed_at"], ["claim_id"]), scratch(s, "inbox")
    kept.orderBy(F.desc("claimed_at"), "url").write.csv(path, header=True, quoteAll=True)
    return s.read.csv(path, header=True, schema="claim_id long, url string, claimed_at date").select("url", "claimed_at", "claim_id")


@query("j22_f3_team_names", """select match_id, case home_id%4 when 0 then 'Team '||home_id when 1 then 'Rovers' when 2 then 'United' else 'Other '||home_id end as name from matches""")
def j22(s, d):
    said = F.element_at(F.array(F.concat(F.lit("Team "), F.col("home_id")), F.lit("ROVERS FC"), F.lit("Utd of the Town"), F.concat(F.lit("Other "), F.col("home_id"))), F.col("home_id") % 4 + 1)
    aliases = s.createDataFrame([("rovers fc", "Rovers"), ("utd of", "United"), ("utd", "City")], "alias string, name string")
    return cl.canonical(t.matches(s, d).select("match_id", said.alias("name")), "name", aliases)
