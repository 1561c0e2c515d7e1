"""Queries on prices, scoreline grids and stakes."""

from pyspark.sql import functions as F

from fieldglass.functions import probability as pr
from fieldglass.operators import league, markets, risk
from fieldglass.sources import tables as t

from .registry import query


def r6(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes if not columns or c in columns])


def P(s, d):
    return t.prices(t.matches(s, d))


def rates(s, d):
    m = t.matches(s, d)
    return markets.rates(m, league.strengths(m))


RATES = """base as (select sum(fthg+ftag)/(2.0::double*count(*)) m from matches where fthg is not null),
st as (select team, round((sum(gf)+6*any_value(m))/(count(*)+6)/any_value(m),6) att, round((sum(ga)+6*any_value(m))/(count(*)+6)/any_value(m),6) de from team_rows, base where gf is not null group by team),
rates as (select match_id, greatest(0.2::double, least(4.0::double, m*h.att*a.de*1.1::double)) home, greatest(0.2::double, least(4.0::double, m*a.att*h.de/1.1::double)) away from matches join st h on h.team=home_id join st a on a.team=away_id, base),
cells as (select match_id, i::int i, j::int j, greatest(0, exp(-home)*power(home,i)/factorial(i::int)*exp(-away)*power(away,j)/factorial(j::int)*case when i=0 and j=0 then 1+home*away*0.05::double when i=0 and j=1 then 1-home*0.05::double when i=1 and j=0 then 1-away*0.05::double when i=1 and j=1 then 1.05::double else 1 end) w from rates, range(8) a(i), range(8) b(j)),
grid as (select match_id, i, j, w/sum(w) over (partition by match_id) p from cells)"""
FAIR = """good as (select *, count(*) over (partition by match_id, book) n, (1/price)/sum(1/price) over (partition by match_id, book) p, sum(1/price) over (partition by match_id, book)-1 margin from prices where price>1), fair as (select * from good where n=3)"""


@query("f34_devig_proportional", f"with {FAIR} select match_id, book, outcome, round(p,6) p from fair")
def f34(s, d):
    return r6(markets.fair(P(s, d)), "match_id", "book", "outcome", "p")


@query("f37_book_margin", "select match_id, book, round(sum(1/price)-1,6) margin, count(distinct outcome) legs, count(distinct outcome)=3 and sum(1/price)-1 between 0.005 and 0.15 single_book from prices where price>1 group by 1,2")
def f37(s, d):
    return r6(markets.book_margins(P(s, d)))


def _devigged(prices, method):
    inverse = prices.groupBy("match_id", "book").agg(*[F.max(F.when(F.col("outcome") == o, 1 / F.col("price"))).alias(o) for o in "HDA"])
    fair = pr.devig(F.array("H", "D", "A"), method)
    return inverse.select("match_id", "book", fair.alias("f")).select("match_id", "book", *[F.round(F.col("f")[i], 5).alias(f"p_{o}") for i, o in enumerate("hda")])


def _bisection(low, high, excess):
    return f"""with recursive q as (select match_id, book, max(1/price) filter (outcome='H') h, max(1/price) filter (outcome='D') d, max(1/price) filter (outcome='A') a from prices group by 1,2),
b as (select match_id, book, h, d, a, {low}::double lo, {high}::double hi, 0 n from q union all select match_id, book, h, d, a, case when {excess}>0 then (lo+hi)/2 else lo end, case when {excess}>0 then hi else (lo+hi)/2 end, n+1 from b where n<60)"""


@query("f35_devig_power", _bisection(0.5, 10.0, "power(h,(lo+hi)/2)+power(d,(lo+hi)/2)+power(a,(lo+hi)/2)-1") + " select match_id, book, round(power(h,(lo+hi)/2),5) p_h, round(power(d,(lo+hi)/2),5) p_d, round(power(a,(lo+hi)/2),5) p_a from b where n=60")
def f35(s, d):
    return _devigged(P(s, d), "power")


_SHIN = "(sqrt({z}*{z}+4*(1-{z})*{q}*{q}/(h+d+a))-{z})/(2*(1-{z}))"


@query("f36_devig_shin", _bisection(0.0, 0.4, "+".join(_SHIN.format(z="((lo+hi)/2)", q=q) for q in "hda") + "-1") + " select match_id, book, " + ", ".join(f"round({_SHIN.format(z='((lo+hi)/2)', q=q)},5) p_{q}" for q in "hda") + " from b where n=60")
def f36(s, d):
    return _devigged(P(s, d), "shin")


@query("f38_apply_margin", f"with {FAIR} select match_id, book, outcome, round(1/(p*1.05::double),6) price from fair")
def f38(s, d):
    return markets.fair(P(s, d)).select("match_id", "book", "outcome", F.round(pr.with_margin(F.col("p"), 0.05), 6).alias("price"))


@query("a16_consensus", f"""with {FAIR}, per as (select match_id, outcome, median(p) q0, count(*) n from fair group by 1,2), q as (select *, q0/sum(q0) over (partition by match_id) q from per),
dis as (select match_id, max(abs(ln(p/(1-p))-ln(q/(1-q)))) x from fair join q using (match_id, outcome) group by 1)
select match_id, round(max(q) filter (outcome='H'),6) p_h, round(max(q) filter (outcome='D'),6) p_d, round(max(q) filter (outcome='A'),6) p_a, max(q.n) books, round(max(q.n)/(max(q.n)+2.0::double),6) weight, round(any_value(x),6) dispersion from q join dis using (match_id) group by match_id""")
def a16(s, d):
    return r6(markets.consensus(P(s, d)))


@query("a16_consensus_two_books", f"""with {FAIR}, two as (select * from fair where book<2), per as (select match_id, outcome, arg_min(p, margin) q0, count(*) n from two group by 1,2), q as (select *, q0/sum(q0) over (partition by match_id) q from per),
dis as (select match_id, max(abs(ln(p/(1-p))-ln(q/(1-q)))) x from two join q using (match_id, outcome) group by 1)
select match_id, round(max(q) filter (outcome='H'),6) p_h, round(max(q) filter (outcome='D'),6) p_d, round(max(q) filter (outcome='A'),6) p_a, max(q.n) books, round(max(q.n)/(max(q.n)+2.0::double),6) weight, round(greatest(any_value(x),0.2::double),6) dispersion from q join dis using (match_id) group by match_id""")
def a16b(s, d):
    return r6(markets.consensus(P(s, d).where(F.col("book") < 2)))


@query("a18_best_price", "select match_id, outcome, round(max(price),6) price, arg_max(book, price)::int book from prices group by 1,2")
def a18(s, d):
    return r6(markets.best_prices(P(s, d)).withColumn("book", F.col("book").cast("int")))


@query("f32_scoreline_grid", f"with {RATES} select match_id, i, j, round(p,6) p from grid")
def f32(s, d):
    return r6(markets.grid(rates(s, d)))


OF = lambda c: f"round(sum(case when {c} then p else 0 end),6)"


@query("x12_markets_from_grid", f"""with {RATES} select match_id, {OF('i>j')} home_win, {OF('i=j')} draw, {OF('i<j')} away_win, {OF('i+j>1')} over_1_5, {OF('i+j>2')} over_2_5, {OF('i+j>3')} over_3_5, {OF('i>0 and j>0')} btts, {OF('j=0')} home_clean_sheet, {OF('i=0')} away_clean_sheet, {OF('i-j>=2')} handicap_home, arg_max(i||'-'||j, p) likeliest from grid group by match_id""")
def x12(s, d):
    return r6(markets.exact_markets(rates(s, d)))


@query("x12_markets_by_grid_rows", f"with {RATES} select match_id, round(sum(p) filter (i>j),6) home_win, round(sum(p) filter (i=j),6) draw, round(sum(p) filter (i+j>2),6) over_2_5 from grid group by 1")
def x12_rows(s, d):
    return r6(markets.markets(markets.grid(rates(s, d))), "match_id", "home_win", "draw", "over_2_5")


@query("x13_half_time_full_time", f"""with {RATES}, g as (select match_id, i::int i, j::int j, exp(-.45::double*home)*power(.45::double*home,i)/factorial(i::int)*exp(-.45::double*away)*power(.45::double*away,j)/factorial(j::int) p, exp(-.55::double*home)*power(.55::double*home,i)/factorial(i::int)*exp(-.55::double*away)*power(.55::double*away,j)/factorial(j::int) q from rates, range(7) a(i), range(7) b(j)),
f as (select match_id, i-j gap, sum(p) p from g group by 1,2), s as (select match_id, i-j gap, sum(q) q from g group by 1,2),
b as (select f.match_id, (case when f.gap>0 then 'H' when f.gap=0 then 'D' else 'A' end)||'/'||(case when f.gap+s.gap>0 then 'H' when f.gap+s.gap=0 then 'D' else 'A' end) as label, sum(p*q) x from f join s using (match_id) group by 1,2)
select match_id, label, round(x/sum(x) over (partition by match_id),6) p from b""")
def x13(s, d):
    return r6(markets.half_time_full_time(rates(s, d)))


BETS = f"""{RATES}, win as (select match_id, sum(p) filter (i>j) h, sum(p) filter (i=j) d, sum(p) filter (i<j) a from grid group by 1), ch as (select match_id, unnest(['H','D','A']) outcome, unnest([h,d,a]) p from win),
best as (select match_id, outcome, max(price) price, arg_max(book,price) book from prices group by 1,2),
ed as (select *, p-fair edge, case outcome when 'H' then 0.03::double when 'D' then 0.04::double else 0.03::double end bar from (select *, (1/price)/sum(1/price) over (partition by match_id) fair from ch join best using (match_id, outcome))),
staked as (select *, case when price>1 and ((price-1)*p-(1-p))/(price-1)>0 and p*price-1>=0 then least(((price-1)*p-(1-p))/(price-1),0.05::double) end stake from ed where edge>=bar)"""


def bets(s, d):
    m = t.matches(s, d)
    w = markets.exact_markets(rates(s, d))
    chances = w.select("match_id", F.col("home_win").alias("H"), F.col("draw").alias("D"), F.col("away_win").alias("A")).unpivot("match_id", ["H", "D", "A"], "outcome", "p")
    return markets.values(chances, markets.best_prices(t.prices(m)), {"H": 0.03, "D": 0.04})


@query("r2_value_bets", f"with {BETS} select match_id, outcome, round(price,6) price, round(edge,6) edge, round(stake,6) stake, case when edge>=2.5*bar then 'high' when edge>=1.5*bar then 'medium' else 'low' end tier from staked where stake is not null")
def r2(s, d):
    return r6(bets(s, d), "match_id", "outcome", "price", "edge", "stake", "tier")


@query("f39_kelly", "select match_id, book, outcome, round(least(((price-1)*0.4::double-0.6::double)/(price-1),0.05::double),6) stake from prices where ((price-1)*0.4::double-0.6::double)/(price-1)>0")
def f39(s, d):
    return P(s, d).select("match_id", "book", "outcome", F.round(pr.kelly(F.lit(0.4), F.col("price")), 6).alias("stake")).where("stake is not null")


@query("f41_entropy", f"with {RATES}, w as (select match_id, sum(p) filter (i>j) h, sum(p) filter (i=j) d, sum(p) filter (i<j) a from grid group by 1) select match_id, round(-h*ln(h)-d*ln(d)-a*ln(a),6) entropy from w")
def f41(s, d):
    w = markets.exact_markets(rates(s, d))
    return w.select("match_id", F.round(pr.entropy([F.col("home_win"), F.col("draw"), F.col("away_win")]), 6).alias("entropy"))


@query("f44_blend_log", f"with {RATES}, {FAIR}, side as (select match_id, book, outcome, p, case outcome when 'H' then home else away end rate from rates join fair using (match_id) where outcome<>'D') select match_id, book, outcome, round(rate*exp(0.6::double*greatest(-0.5::double, least(0.5::double, ln(3*p/rate)))),6) blended from side")
def f44(s, d):
    """Both sides' rates with every book; a draw has no rate of its own."""
    j = rates(s, d).join(markets.fair(P(s, d)).where("outcome <> 'D'"), "match_id").withColumn("rate", F.when(F.col("outcome") == "H", F.col("home")).otherwise(F.col("away")))
    return j.select("match_id", "book", "outcome", F.round(pr.blend_log(F.col("rate"), 3 * F.col("p"), 0.6), 6).alias("blended"))


@query("f45_anytime_radius", """with g as (select home_id, count(*) n, stddev_samp(fthg-ftag) s from matches where fthg is not null group by 1) select home_id, round(s*sqrt(2*(n*0.01::double+1)/(n*n*0.01::double)*ln(sqrt(n*0.01::double+1)/0.05::double)),6) radius from g""")
def f45(s, d):
    g = t.matches(s, d).where("fthg is not null").groupBy("home_id").agg(F.count("*").alias("n"), F.stddev_samp(F.col("fthg") - F.col("ftag")).alias("sd"))
    return g.select("home_id", F.round(pr.anytime_radius(F.col("n"), F.col("sd")), 6).alias("radius"))


@query("r5_portfolio_limits")
def r5(s, d):
    """No SQL: each stake depends on all before it on its card and on six exposures at once; a plain loop over every card is in the tests."""
    return r6(risk.portfolio(all_bets(s, d)))


def all_bets(s, d):
    """1X2 and goal bets with teams and nests."""
    m = t.matches(s, d)
    w = markets.exact_markets(rates(s, d))
    sides = {"over 1.5": F.col("over_1_5"), "over 2.5": F.col("over_2_5"), "under 3.5": 1 - F.col("over_3_5"), "under 2.5": 1 - F.col("over_2_5")}
    over = w.select("match_id", F.inline(F.array(*[F.struct(F.lit(k).alias("outcome"), p.alias("p")) for k, p in sides.items()])))
    price = 1 / (F.col("p") * 0.9) + (F.col("match_id") * 7 + F.length("outcome")) % 10 / 50.0
    goals = over.withColumn("price", price).withColumn("edge", F.col("p") - 1 / F.col("price")).withColumn("stake", pr.kelly(F.col("p"), F.col("price"))).where("edge >= 0.03 and stake is not null")
    one = bets(s, d).select("match_id", "outcome", "edge", "stake")
    return risk.with_teams(one.unionByName(goals.select("match_id", "outcome", "edge", "stake")), m)


@query("r5_single_cap", f"""with {BETS}, k as (select match_id, outcome, stake, coalesce(sum(stake) over (partition by match_id order by edge desc, outcome rows between unbounded preceding and 1 preceding),0) prev from staked where stake is not null)
select match_id, outcome, round(least(stake, greatest(0, 0.06::double-prev)),6) stake from k""")
def r5b(s, d):
    return r6(risk.single_cap(bets(s, d), ["match_id"], 0.06))


@query("w13_drawdown", """with r as (select match_date, match_id, exp(sum(ln(1+case when fthg>ftag then 0.02::double else -0.015::double end)) over (partition by home_id order by match_date, match_id)) bank, home_id from matches where fthg is not null),
p as (select *, max(bank) over (partition by home_id order by match_date, match_id) peak from r)
select home_id, match_id, round(greatest(peak,1)-bank,7) fall, round(1-bank/greatest(peak,1),7) drawdown, case when 1-bank/greatest(peak,1)>=0.3 then 'stop' when 1-bank/greatest(peak,1)>=0.2 then 'half' else 'normal' end status from p""")
def w13(s, d):
    m = t.matches(s, d).where("fthg is not null").withColumn("gain", F.when(F.col("fthg") > F.col("ftag"), 0.02).otherwise(-0.015))
    return risk.drawdown(m, ["home_id"], ["match_date", "match_id"]).select("home_id", "match_id", F.round(F.col("peak") - F.col("bank"), 7).alias("fall"), F.round("drawdown", 7).alias("drawdown"), "status")
