"""Cleaning of season files and nested price feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Texts that stand for no value. Fixed values.
NULLS = ("", "na", "n/a", "nan", "none", "null", "-", "tbc")


def text(c: Column) -> Column:
    """Trimmed; null for a null token."""
    trimmed = F.trim(c)
    return F.when(~F.lower(trimmed).isin(*NULLS), trimmed)


def match_date(raw: Column) -> Column:
    """dd/MM/yyyy, else dd/MM/yy with 69 to 99 in the last century; null for any other text or no day of the calendar."""
    raw = F.trim(raw)
    year = F.regexp_extract(raw, r"^\d{2}/\d{2}/(\d{2})$", 1)
    whole = F.when(raw.rlike(r"^\d{2}/\d{2}/\d{4}$"), raw).when(year != "", F.concat(F.substring(raw, 1, 6), F.when(year >= "69", "19").otherwise("20"), year))
    return F.try_to_timestamp(whole, F.lit("dd/MM/yyyy")).cast("date")


def match_key(day: Column, home: Column, away: Column) -> Column:
    """yyyymmdd_Home_Away with underscores for spaces, as everywhere."""
    return F.replace(F.concat_ws("_", F.date_format(day, "yyyyMMdd"), home, away), F.lit(" "), F.lit("_"))


def canonical(names: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """`column` by alias: an exact one; else the first alias, by length then text, that holds the name or is held by it; else itself.

    Only distinct names meet the aliases (alias, name); the aliases are few and the match by part is on those names alone.
    """
    known = names.select(F.col(column).alias("_raw")).distinct()
    low = F.lower("_raw")
    exact = known.join(aliases.select(F.lower("alias").alias("_a"), F.col("name").alias("_exact")), low == F.col("_a"), "left").drop("_a")
    part = F.contains(low, F.lower("alias")) | F.contains(F.lower("alias"), low)
    near = exact.where("_exact is null and length(_raw) > 0").join(aliases, part).groupBy("_raw").agg(F.min_by("name", F.struct(-F.length("alias"), "alias")).alias("_near"))
    found = exact.join(near, "_raw", "left").select("_raw", F.coalesce("_exact", "_near", "_raw").alias("_name"))
    return names.join(found, names[column] == found["_raw"], "left").withColumn(column, F.coalesce("_name", F.col(column))).drop("_raw", "_name")


def clean_matches(raw: DataFrame) -> DataFrame:
    """Played matches of season files: match_key, season_code, match_date, home, away, fthg, ftag, hs, referee.

    Rows without a date or either score go; other numbers that do not parse are null; referees have one spelling.
    """
    number = lambda c: text(F.col(c)).try_cast("int")
    rows = raw.select("season_code", match_date(F.col("Date")).alias("match_date"), text(F.col("HomeTeam")).alias("home"), text(F.col("AwayTeam")).alias("away"), number("FTHG").alias("fthg"), number("FTAG").alias("ftag"), number("HS").alias("hs"), F.initcap(text(F.col("Referee"))).alias("referee"))
    rows = rows.dropna(subset=["match_date", "home", "away", "fthg", "ftag"])
    return rows.select(match_key(F.col("match_date"), F.col("home"), F.col("away")).alias("match_key"), *rows.columns)


def closing_prices(raw: DataFrame, books: tuple[str, ...]) -> DataFrame:
    """Wide closing prices: one column a book and outcome, null where the file has no such column or the price is not above 1."""
    price = lambda c: text(F.col(c)).try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    wide = raw.select("*", *[price(f"{b}{o}").alias(f"_{b}{o}") for b in books for o in "HDA"])
    kept = [F.when(F.col(f"_{b}{o}") > 1, F.col(f"_{b}{o}")).alias(f"{b}{o}") for b in books for o in "HDA"]
    return wide.select(match_key(match_date(F.col("Date")), text(F.col("HomeTeam")), text(F.col("AwayTeam"))).alias("match_key"), *kept)


def closing_market(wide: DataFrame, books: tuple[str, ...]) -> DataFrame:
    """(match_key, book, outcome, price) of the books that price all three outcomes, from the wide table in place."""
    entry = lambda b: F.struct(F.lit(b).alias("book"), *[F.col(f"{b}{o}").alias(o) for o in "HDA"])
    rows = wide.select("match_key", F.inline(F.array(*map(entry, books)))).dropna(subset=["H", "D", "A"])
    return rows.unpivot(["match_key", "book"], ["H", "D", "A"], "outcome", "price")


#: An event of a price feed.
EVENT = (
    "id long, home_team string, away_team string, bookmakers array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,point:double,price:double>>>>>>"
)


def quotes(events: DataFrame) -> DataFrame:
    """(id, home_team, away_team, book, market, name, point, price) of nested events (EVENT); prices not above 1 go."""
    rows = events.select("id", "home_team", "away_team", F.explode("bookmakers").alias("b")).select("id", "home_team", "away_team", F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    rows = rows.select("id", "home_team", "away_team", "book", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o"))
    return rows.select("id", "home_team", "away_team", "book", "market", "o.name", "o.point", "o.price").where("price > 1")


def head_to_head(rows: DataFrame) -> DataFrame:
    """1X2 prices (id, book, outcome, price): sides by the event's own names; a book without all three goes. No shuffle but one by id."""
    side = F.when(F.col("name") == F.col("home_team"), "H").when(F.col("name") == F.col("away_team"), "A").when(F.lower("name") == "draw", "D")
    sides = rows.where("market = 'h2h'").withColumn("outcome", side).where("outcome is not null")
    whole = sides.groupBy("id", "book").agg(*[F.max(F.when(F.col("outcome") == o, F.col("price"))).alias(o) for o in "HDA"]).dropna()
    return whole.unpivot(["id", "book"], ["H", "D", "A"], "outcome", "price")


def best_totals(rows: DataFrame) -> DataFrame:
    """(id, line, side, price, book): the best price of each line and side; of equal ones the first book by name."""
    totals = rows.where("market = 'totals' and point is not null").select("id", F.col("point").alias("line"), F.lower("name").alias("side"), "price", "book")
    return totals.groupBy("id", "line", "side").agg(F.max("price").alias("price"), F.max_by("book", F.struct("price", F.transform(F.split("book", ""), lambda c: -F.ascii(c)))).alias("book"))


def flat_markets(chances: DataFrame, column: str = "markets") -> DataFrame:
    """(match_id, market, p) of a map from market to chance."""
    return chances.select("match_id", F.explode(column).alias("market", "p"))
