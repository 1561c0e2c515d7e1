"""Queries on implied rates and on value bets over all markets. Quotes lean from our chances by each order's own total price."""

from pyspark.sql import functions as F

from fieldglass.functions import probability as pr
from fieldglass.operators import inversion, markets, value
from fieldglass.sources import tables as t

from .markets import RATES, rates
from .registry import query

LINES = (1.5, 2.5, 3.5)


def chances(s, d):
    """Our chances in long form: results, goals over and under two lines, both to score, cards over and under 3.5."""
    m = t.matches(s, d)
    wide = markets.exact_markets(rates(s, d)).join(m.select("match_id", "hy", "ay"), "match_id")
    mean = m.agg(F.avg(F.col("hy") + F.col("ay")).alias("m"))  # one row
    few = lambda r: F.exp(-r) * (1 + r + r * r / 2 + r * r * r / 6)
    wide = wide.crossJoin(F.broadcast(mean)).withColumn("few_cards", few(F.col("m")))
    line = lambda x: F.lit(x).cast("double")
    rows = [("1x2", line(None), "home", F.col("home_win")), ("1x2", line(None), "draw", F.col("draw")), ("1x2", line(None), "away", F.col("away_win")), ("btts", line(None), "yes", F.col("btts")), ("btts", line(None), "no", 1 - F.col("btts"))]
    rows += [("over_under", line(x), side, p) for x in (2.5, 3.5) for side, p in (("over", F.col(f"over_{int(x)}_5")), ("under", 1 - F.col(f"over_{int(x)}_5")))]
    rows += [("cards", line(3.5), "over", 1 - F.col("few_cards")), ("cards", line(3.5), "under", F.col("few_cards"))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("market"), ln.alias("line"), F.lit(o).alias("outcome"), p.alias("p")) for k, ln, o, p in rows]))
    return wide.select("match_id", each.alias("c")).select("match_id", "c.*")


def quotes(s, d):
    """Prices that lean by a share of the order's total from our chances; an order still open quotes one side of cards alone."""
    o = t.table(s, d, "orders").select(F.col("o_orderkey").alias("match_id"), (F.col("o_totalprice") % 1000 / 1000).alias("lean"), "o_orderstatus")
    rows = chances(s, d).join(o, "match_id").where("o_orderstatus <> 'O' or market <> 'cards' or outcome = 'over'")
    p = 0.7 * F.col("p") + 0.3 * F.when(F.col("outcome").isin("home", "over", "yes"), F.col("lean")).when(F.col("outcome") == "draw", (1 - F.col("lean")) * 0.4).when(F.col("outcome") == "away", (1 - F.col("lean")) * 0.6).otherwise(1 - F.col("lean"))
    return rows.select("match_id", "market", "line", "outcome", F.explode(F.array(*[F.struct(F.lit(b).alias("book"), (1 / (p * (1.02 + 0.01 * b))).alias("price")) for b in range(3)])).alias("q")).select("match_id", "market", "line", "outcome", "q.book", "q.price")


@query("r2_all_markets", f"""with {RATES}, w as (select match_id, sum(p) filter (i>j) h, sum(p) filter (i=j) d, sum(p) filter (i<j) a, sum(p) filter (i>0 and j>0) b, sum(p) filter (i+j>2) o2, sum(p) filter (i+j>3) o3 from grid group by 1), mm as (select avg(hy+ay) m from matches), fc as (select exp(-m)*(1+m+m*m/2+m*m*m/6) f from mm),
ch as (select match_id, unnest([struct_pack(market:='1x2', line:=null::double, outcome:='home', p:=h), struct_pack(market:='1x2', line:=null::double, outcome:='draw', p:=d), struct_pack(market:='1x2', line:=null::double, outcome:='away', p:=a), struct_pack(market:='btts', line:=null::double, outcome:='yes', p:=b), struct_pack(market:='btts', line:=null::double, outcome:='no', p:=1-b), struct_pack(market:='over_under', line:=2.5::double, outcome:='over', p:=o2), struct_pack(market:='over_under', line:=2.5::double, outcome:='under', p:=1-o2), struct_pack(market:='over_under', line:=3.5::double, outcome:='over', p:=o3), struct_pack(market:='over_under', line:=3.5::double, outcome:='under', p:=1-o3), struct_pack(market:='cards', line:=3.5::double, outcome:='over', p:=1-f), struct_pack(market:='cards', line:=3.5::double, outcome:='under', p:=f)]) c from w, fc),
cs as (select match_id, c.market market, c.line line, c.outcome outcome, c.p p, o_totalprice%1000/1000 lean, o_orderstatus st from ch join orders on o_orderkey=match_id),
q as (select *, 1/((0.7::double*p+0.3::double*(case when outcome in ('home','over','yes') then lean when outcome='draw' then (1-lean)*0.4::double when outcome='away' then (1-lean)*0.6::double else 1-lean end))*1.02::double) price from cs where st<>'O' or market<>'cards' or outcome='over'),
im as (select *, case when count(*) over k>1 then 1/price/sum(1/price) over k else 1/price end implied, case market when 'cards' then 0.08::double else 0.05::double end bar from q where price>1 window k as (partition by match_id, market, line)),
sk as (select *, p-implied edge, ((price-1)*p-(1-p))/(price-1) kelly from im)
select match_id, market, line, outcome, 0 as book, round(price,6) price, round(p,6) p, round(implied,6) implied, round(edge,6) edge, round(least(kelly,0.05),6) stake, round(least(kelly,0.05)/2,6) half_stake, round(p*(price-1)-(1-p),6) as value, case when edge>=2.5*bar then 'high' when edge>=1.5*bar then 'medium' else 'low' end tier from sk where edge>=bar and kelly>0""")
def r2_all(s, d):
    out = value.value_bets(chances(s, d), value.best_quotes(quotes(s, d)))
    return out.select("match_id", "market", "line", "outcome", "book", *[F.round(c, 6).alias(c) for c in ("price", "p", "implied", "edge", "stake", "half_stake", "value")], "tier")


def totals(s, d):
    """Each line's consensus over the books' two-sided quotes: median of the fair chances, weight and dispersion as of results."""
    wide = markets.exact_markets(rates(s, d)).join(t.table(s, d, "orders").select(F.col("o_orderkey").alias("match_id"), (F.col("o_totalprice") % 1000 / 1000).alias("lean")), "match_id")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("line"), F.col(f"over_{int(x)}_5").alias("p")) for x in LINES]))
    book = wide.select("match_id", "lean", each.alias("l"), F.explode(F.array(*map(F.lit, range(3)))).alias("book")).select("match_id", "book", "l.line", (pr.logit(F.col("l.p")) + (F.col("lean") - 0.5) * 0.6 + (F.col("book") - 1) * 0.05).alias("odds"))
    p = pr.sigmoid(F.median("odds"))
    return book.groupBy("match_id", "line").agg(p.alias("p_over"), (F.count("*") / (F.count("*") + 2)).alias("weight"), F.max(F.abs((F.col("book") - 1) * 0.05)).alias("dispersion"))


@query("m11_market_rates")
def m11(s, d):
    """All books' results and three lines of goals at once. Beyond SQL; the tests find known rates again."""
    own = rates(s, d)
    out = inversion.market_rates(markets.consensus(t.prices(t.matches(s, d))), totals(s, d), leads=own.select("match_id", (F.col("home") - F.col("away")).alias("lead")))
    return out.select("match_id", *[F.round(c, 4).alias(c) for c in ("home", "away", "residual", "weight")], "status", "constraints")
