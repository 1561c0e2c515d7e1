"""Markets from prices and from scoreline grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldglass.functions import probability as pr


def book_margins(prices: DataFrame) -> DataFrame:
    """Per match and book: margin, whether all legs are there, and whether it is plausible for a single book."""
    m = prices.where("price > 1").groupBy("match_id", "book").agg((F.sum(1 / F.col("price")) - 1).alias("margin"), F.countDistinct("outcome").alias("legs"))
    return m.withColumn("single_book", (F.col("legs") == 3) & F.col("margin").between(0.005, 0.15))


def fair(prices: DataFrame) -> DataFrame:
    """Proportional fair probability of each leg of each complete book."""
    full = F.count("*").over(W.partitionBy("match_id", "book")) == 3
    good = prices.where("price > 1").withColumn("full", full).where("full").drop("full")
    return good.withColumn("p", pr.proportional(F.col("price"), ["match_id", "book"]))


def consensus(prices: DataFrame, few: int = 3) -> DataFrame:
    """Across books: each outcome's median fair probability, renormalised; with fewer than `few` books that of the lowest margin.

    weight is n / (n + 2); dispersion the largest distance in log odds of any book from it, 0.2 at least with few books.
    """
    # dealt out by match once: every window and sum below keeps to that
    p = fair(prices.repartition("match_id")).withColumn("margin", F.sum(1 / F.col("price")).over(W.partitionBy("match_id", "book")) - 1)
    leg = W.partitionBy("match_id", "outcome")
    p = p.withColumns({"n": F.count("*").over(leg), "middle": F.median("p").over(leg), "tightest": F.min_by("p", F.struct("margin", "book")).over(leg)})
    p = p.withColumn("raw", F.when(F.col("n") < few, F.col("tightest")).otherwise(F.col("middle")))
    # each leg's value stands in n rows
    p = p.withColumn("q", F.col("raw") / F.sum(F.col("raw") / F.col("n")).over(W.partitionBy("match_id")))
    far = F.max(F.abs(pr.logit(F.col("p")) - pr.logit(F.col("q"))))
    wide = p.groupBy("match_id").agg(*[F.max(F.when(F.col("outcome") == o, F.col("q"))).alias(f"p_{o.lower()}") for o in "HDA"], F.max("n").alias("books"), far.alias("dispersion"))
    return wide.select("match_id", *[f"p_{o}" for o in "hda"], "books", (F.col("books") / (F.col("books") + 2)).alias("weight"), F.when(F.col("books") < few, F.greatest("dispersion", F.lit(0.2))).otherwise(F.col("dispersion")).alias("dispersion"))


def best_prices(prices: DataFrame) -> DataFrame:
    """Best price of each outcome and its book; of equal prices the lowest book's."""
    return prices.groupBy("match_id", "outcome").agg(F.max("price").alias("price"), F.max_by("book", F.struct("price", -F.col("book"))).alias("book"))


def rates(matches: DataFrame, strengths: DataFrame, home_edge: float = 1.1) -> DataFrame:
    """Expected goals of both sides from attack and defence, held within 0.2 and 4."""
    base = matches.where("fthg is not null").agg((F.sum(F.col("fthg") + F.col("ftag")) / (2 * F.count("*"))).alias("m"))
    h = strengths.select(F.col("team").alias("home_id"), F.col("attack").alias("ha"), F.col("defence").alias("hd"))
    a = strengths.select(F.col("team").alias("away_id"), F.col("attack").alias("aa"), F.col("defence").alias("ad"))
    clip = lambda x: F.greatest(F.lit(0.2), F.least(F.lit(4.0), x))
    j = matches.join(h, "home_id").join(a, "away_id").crossJoin(F.broadcast(base))
    return j.select("match_id", clip(F.col("m") * F.col("ha") * F.col("ad") * home_edge).alias("home"), clip(F.col("m") * F.col("aa") * F.col("hd") / home_edge).alias("away"))


def _pmf(expected: DataFrame, share: float, top: int, name: str) -> DataFrame:
    """Adds {name}h0 .. and {name}a0 ..: chances of each number of goals of either side up to `top`."""
    return expected.withColumns({f"{name}{side[0]}{k}": pr.poisson(F.col(side) * share, k) for side in ("home", "away") for k in range(top + 1)})


def _total(columns) -> Column:
    found = list(columns)
    return reduce(Column.__add__, found) if found else F.lit(0.0)


def _weights(expected: DataFrame, rho: float, top: int) -> tuple[DataFrame, dict[tuple[int, int], Column]]:
    """The rates with `total`, and the scores' weights by (i, j), in that order, that add up to it."""
    g, goals = _pmf(expected, 1.0, top, "_"), range(top + 1)
    cell = lambda i, j: F.col(f"_h{i}") * F.col(f"_a{j}")
    low = {(i, j): F.greatest(F.lit(0.0), cell(i, j) * pr.low_score_factor(F.lit(i), F.lit(j), F.col("home"), F.col("away"), F.lit(rho))) for i in (0, 1) for j in (0, 1)}
    whole = _total(F.col(f"_h{i}") for i in goals) * _total(F.col(f"_a{j}") for j in goals) + _total(low[c] - cell(*c) for c in low)
    return g.withColumn("total", whole), {(i, j): low.get((i, j), cell(i, j)) for i in goals for j in goals}


def _cells(expected: DataFrame, rho: float, top: int) -> tuple[DataFrame, Column]:
    """The rates with `total`, and an array of the scores' weights (i, j, p; by i, then j)."""
    g, weights = _weights(expected, rho, top)
    return g, F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), p.alias("p")) for (i, j), p in weights.items()])


def score_cells(expected: DataFrame, rho: float = -0.05, top: int = 7) -> DataFrame:
    """Per match the weights of the scores (cells) and their total."""
    g, cells = _cells(expected, rho, top)
    return g.select("match_id", "total", cells.alias("cells"))


def grid(expected: DataFrame, rho: float = -0.05, top: int = 7) -> DataFrame:
    """Probability of each score up to `top` a side (match_id, i, j, p), low scores corrected, adding up to 1.

    (top + 1)^2 rows a match, made in place from plain expressions: no join, no shuffle, all compiled.
    """
    g, cells = _cells(expected, rho, top)
    # the array stands inside explode: an array column would be copied into an inferred filter
    return g.select("match_id", "total", F.explode(cells).alias("c")).select("match_id", "c.i", "c.j", (F.col("c.p") / F.col("total")).alias("p"))


def score_chance(rows: DataFrame, i: Column, j: Column, rho: float = -0.05, top: int = 7) -> DataFrame:
    """rows (home, away) with p, what grid() has for the row's own score i, j; null for a score outside it."""
    g, _ = _weights(rows, rho, top)
    goals = lambda side, k: F.get(F.array(*[F.col(f"_{side}{n}") for n in range(top + 1)]), k)
    plain = goals("h", i) * goals("a", j)
    low = F.greatest(F.lit(0.0), plain * pr.low_score_factor(i, j, F.col("home"), F.col("away"), F.lit(rho)))
    return g.withColumn("p", F.when((i <= 1) & (j <= 1), low).otherwise(plain) / F.col("total")).select(*rows.columns, "p")


def markets(scores: DataFrame) -> DataFrame:
    """Wide exact markets of each match from its grid."""
    i, j = F.col("i"), F.col("j")
    of = lambda c: F.sum(F.when(c, F.col("p")).otherwise(0.0))
    return scores.groupBy("match_id").agg(
        of(i > j).alias("home_win"), of(i == j).alias("draw"), of(i < j).alias("away_win"), *[of(i + j > line).alias(f"over_{int(line)}_5") for line in (1.5, 2.5, 3.5)], of((i > 0) & (j > 0)).alias("btts"),
        of(j == 0).alias("home_clean_sheet"), of(i == 0).alias("away_clean_sheet"), of(i - j >= 2).alias("handicap_home"), F.max_by(F.concat_ws("-", i, j), F.struct("p", -i, -j)).alias("likeliest"),
    )


def exact_markets(expected: DataFrame, rho: float = -0.05, top: int = 7) -> DataFrame:
    """What markets() makes of grid(), from the chances of either side's goals in the row itself: no rows a score, no shuffle."""
    g, weights = _weights(expected, rho, top)
    goals = range(top + 1)
    h, a = [F.col(f"_h{i}") for i in goals], [F.col(f"_a{j}") for j in goals]
    extra = {(i, j): F.greatest(F.lit(0.0), h[i] * a[j] * pr.low_score_factor(F.lit(i), F.lit(j), F.col("home"), F.col("away"), F.lit(rho))) - h[i] * a[j] for i in (0, 1) for j in (0, 1)}
    of = lambda plain, rule: (plain + _total(x for c, x in extra.items() if rule(*c))) / F.col("total")
    lead = lambda x, y, by: _total(x[i] * _total(y[: i - by + 1]) for i in goals if i >= by)
    under = {n: of(_total(h[i] * a[k - i] for k in range(n + 1) for i in range(k + 1)), lambda i, j, n=n: i + j <= n) for n in (1, 2, 3)}
    # of equal weights the first place, so fewer home goals, then fewer away goals
    place = F.array_position("_weights", F.array_max("_weights")) - 1
    g = g.withColumn("_weights", F.array(*weights.values())).withColumn("_place", place)
    return g.select(
        "match_id", of(lead(h, a, 1), lambda i, j: i > j).alias("home_win"), of(_total(h[i] * a[i] for i in goals), lambda i, j: i == j).alias("draw"), of(lead(a, h, 1), lambda i, j: i < j).alias("away_win"),
        *[(1 - p).alias(f"over_{n}_5") for n, p in under.items()], of(_total(h[1:]) * _total(a[1:]), lambda i, j: i > 0 and j > 0).alias("btts"), of(_total(h) * a[0], lambda i, j: j == 0).alias("home_clean_sheet"),
        of(h[0] * _total(a), lambda i, j: i == 0).alias("away_clean_sheet"), of(lead(h, a, 2), lambda i, j: False).alias("handicap_home"), F.concat_ws("-", F.expr(f"_place div {top + 1}"), F.col("_place") % (top + 1)).alias("likeliest"),
    )


def half_time_full_time(expected: DataFrame, share: float = 0.45, top: int = 6) -> DataFrame:
    """Joint result at half and full time: independent Poisson goals of the halves. Nine rows a match, made in place."""
    g = _pmf(_pmf(expected, share, top, "_f"), 1 - share, top, "_s")
    gaps, goals = range(-top, top + 1), range(top + 1)
    for half in "fs":  # chances of each lead after a half's own goals
        g = g.withColumns({f"_{half}{d + top}": _total(F.col(f"_{half}h{i}") * F.col(f"_{half}a{i - d}") for i in goals if i - d in goals) for d in gaps})
    sign = lambda x: "H" if x > 0 else "D" if x == 0 else "A"
    joint = {f"{a}/{b}": _total(F.col(f"_f{d + top}") * _total(F.col(f"_s{e + top}") for e in gaps if sign(d + e) == b) for d in gaps if sign(d) == a) for a in "HDA" for b in "HDA"}
    g = g.withColumns({f"_{k}": v for k, v in joint.items()})
    labels = F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"`_{k}`").alias("p")) for k in joint])
    g = g.withColumn("total", _total(F.col(f"`_{k}`") for k in joint))
    return g.select("match_id", "total", F.explode(labels).alias("x")).select("match_id", "x.label", (F.col("x.p") / F.col("total")).alias("p"))


def values(chances: DataFrame, best: DataFrame, thresholds: dict[str, float], margin: DataFrame | None = None) -> DataFrame:
    """Bets whose edge over the best price's fair probability reaches the outcome's threshold, with stakes and tiers."""
    bar = reduce(lambda acc, kv: acc.when(F.col("outcome") == kv[0], kv[1]), thresholds.items(), F.when(F.lit(False), 0.0)).otherwise(0.03)
    j = chances.join(best, ["match_id", "outcome"]).withColumn("fair", pr.proportional(F.col("price"), ["match_id"])).withColumn("edge", F.col("p") - F.col("fair")).withColumn("bar", bar)
    stake: Column = pr.kelly(F.col("p"), F.col("price"))
    return j.where("edge >= bar").withColumn("stake", stake).where("stake is not null").withColumn("tier", pr.tier(F.col("edge"), F.col("bar")))
