"""News and posts: availability notes, relevance, scope, clubs, headlines, bet labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Body parts by kind. Fixed values.
MUSCULAR = ("hamstring", "calf", "groin", "thigh", "muscle", "quad")
LIGAMENT = ("knee", "ankle", "achilles", "acl", "ligament")
#: Words of each family that make a post relevant, and those that make it promotion. Fixed values.
FAMILIES = {"injury": ("injury", "injured", "knock", "scan"), "lineup": ("lineup", "benched", "starts"), "transfer": ("loan", "signs", "transfer")}
WEAK = ("transfer",)
PROMOTION = r"(?i)\b(promo code|free bet|odds boost|giveaway)\b"
OUT_OF_SCOPE = (r"(?i)\bu-?(18|21|23)s?\b", r"(?i)\bwomen\b", r"(?i)\bacademy\b")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def injury_kind(part: Column) -> Column:
    words = F.split(F.lower(part), "[^a-z]+")
    has = lambda group: F.arrays_overlap(words, F.array(*map(F.lit, group)))
    return F.when(has(MUSCULAR), "muscular").when(has(LIGAMENT), "ligament").otherwise("unspecified")


def dated(day: Column, month: Column, anchor: Column) -> Column:
    """The date of a day and month without a year: the anchor's year, or the next one if that is over 60 days before the anchor; null if there is no such day."""
    at = lambda year: F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
    this = at(F.year(anchor))
    return F.when(F.datediff(anchor, this) > 60, at(F.year(anchor) + 1)).otherwise(this)


def availability(news: DataFrame, text: str = "news", added: str = "added") -> DataFrame:
    """news with kind, part, injury, chance and back of its note; patterns stand at the start, the first that fits counts.

    left: has joined or left for good or on loan. suspended: until a date. expected: an injury with a date. chance: an injury
    with a share. unknown: an injury whose end is not known. none: anything else.
    """
    c = F.col(text)
    part = F.regexp_extract(c, r"^([A-Za-z ]+?) (?:injury|problem) - ", 1)
    day = r"(\d{1,2}) ([A-Z][a-z]{2})"
    until, back = F.regexp_extract(c, rf"^Suspended until {day}", 0), F.regexp_extract(c, rf" - Expected back {day}", 0)
    share = F.regexp_extract(c, r" - (\d{1,3})% chance of playing", 1).try_cast("int")
    kind = F.when(c.rlike(r"^(Has joined|Has left|Joined) "), "left").when(until != "", "suspended").when((part != "") & (back != ""), "expected").when((part != "") & share.isNotNull(), "chance").when((part != "") & c.rlike(r" - Unknown return"), "unknown").otherwise("none")
    when = F.coalesce(F.nullif(until, F.lit("")), back)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(when, rf"{day}$", 2)))
    back_on = F.when(F.col("kind").isin("suspended", "expected"), dated(F.regexp_extract(when, rf"{day}$", 1).try_cast("int"), month.cast("int"), F.col(added)))
    chance = F.when(F.col("kind") == "chance", share).when(F.col("kind").isin("left", "suspended", "expected", "unknown"), 0)
    hurt = F.col("kind").isin("expected", "chance", "unknown")
    return news.withColumn("kind", kind).withColumns({"part": F.when(hurt, F.lower(part)), "injury": F.when(hurt, injury_kind(part)), "chance": chance, "back": back_on})


def out_of_scope(text: Column) -> Column:
    hit = F.lit(False)
    for pattern in OUT_OF_SCOPE:
        hit |= text.rlike(pattern)
    return hit


def signals(text: Column) -> Column:
    """The families whose words the text has."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b({'|'.join(words)})\b"), F.lit(name)) for name, words in FAMILIES.items()]))


def only_club(text: Column, clubs: list[str]) -> Column:
    """The one club that the text names; null if it names none or several."""
    named = F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b{club}\b"), F.lit(club)) for club in clubs]))
    return F.when(F.size(named) == 1, named[0])


def relevance(posts: DataFrame, clubs: list[str], text: str = "text", trusted: str = "trusted") -> DataFrame:
    """posts with club, families and the verdict: promotion, out of scope, no signal, weak signal (of a source that is not trusted), no club, or relevant."""
    c = F.col(text)
    rows = posts.withColumn("families", signals(c)).withColumn("club", only_club(c, clubs))
    weak = F.forall("families", lambda f: f.isin(*WEAK)) & ~F.col(trusted)
    verdict = F.when(c.rlike(PROMOTION), "promotion").when(out_of_scope(c), "out of scope").when(F.size("families") == 0, "no signal").when(weak, "weak signal").when(F.col("club").isNull(), "no club").otherwise("relevant")
    return rows.withColumn("verdict", verdict)


def checked(rows: DataFrame, now: Column, kinds: list[str]) -> DataFrame:
    """rows of an outside feed with the first reason to reject each, null if accepted."""
    reason = F.when(F.col("id").isNull(), "no id").when(F.col("ts").isNull(), "no time").when(F.col("ts") > now, "future").when(~F.col("kind").isin(kinds), "kind").when(F.length(F.trim("quote")) < 3, "no quote")
    return rows.withColumn("reason", reason)


def headline(text: Column) -> Column:
    """First line that is not empty, without outer blanks."""
    return F.trim(F.element_at(F.filter(F.split(text, "\n"), lambda line: F.trim(line) != ""), 1))


def body_lines(text: Column, header: int, footer: int) -> Column:
    """Non-empty lines without the first `header` and the last `footer` of them."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line) != "")
    return F.slice(lines, header + 1, F.greatest(F.lit(0), F.size(lines) - header - footer))


def paragraphs(html: Column, most: int = 120) -> Column:
    """Texts of the page's <p> elements that are not empty, `most` at most (a page's display limit)."""
    inner = F.regexp_extract_all(html, F.lit(r"<p>(?s:(.*?))</p>"), 1)
    plain = F.transform(inner, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", ""), r"[ \t\n\r]+", " ")))
    return F.slice(F.filter(plain, lambda p: p != ""), 1, most)


def bet_line(label: Column) -> Column:
    """The number in a label such as Over 2.5."""
    return F.regexp_extract(label, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def bet_direction(market: Column, label: Column) -> Column:
    """Whether a bet wants goals: over and yes, under and no, else the side itself."""
    low = F.lower(label)
    return F.when(F.startswith(low, F.lit("over")) | (low == "yes"), "goals").when(F.startswith(low, F.lit("under")) | (low == "no"), "no goals").otherwise(low)


def nesting_key(match_id: Column, market: Column, label: Column) -> Column:
    """Bets of one match and direction on goals contain each other; null for others."""
    way = bet_direction(market, label)
    return F.when(way.isin("goals", "no goals"), F.concat_ws(":", match_id.cast("string"), way))


def clean_name(name: Column) -> Column:
    """Lower case, letters and single blanks only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z ]", " "), " +", " "))


def same_person(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, stage) of archive players found among the current ones: by full name, else web name, else first and last name.

    Tables: id, full, web, first, last, team. At a stage a name that several current players share counts only for the one
    of the same team; otherwise the player goes to the next stage, and is left out after the last.
    """
    stages = {"full": clean_name(F.col("full")), "web": clean_name(F.col("web")), "parts": F.concat_ws(" ", clean_name(F.col("first")), clean_name(F.col("last")))}
    left, out = old.select(F.col("id").alias("old_id"), F.col("team").alias("_team"), *[k.alias(f"_{n}") for n, k in stages.items()]), None
    for name, key in stages.items():
        right = new.select(key.alias("_key"), F.col("id").alias("new_id"), F.col("team").alias("_now"))
        single = right.groupBy("_key").agg(F.count("*").alias("_n"), F.min("new_id").alias("_only"))
        local = right.groupBy("_key", F.col("_now").alias("_team")).agg(F.count("*").alias("_m"), F.min("new_id").alias("_here"))
        left = left.join(single.withColumnRenamed("_key", f"_{name}"), f"_{name}", "left").join(local.withColumnRenamed("_key", f"_{name}"), [f"_{name}", "_team"], "left")
        found = F.when(F.col("_n") == 1, F.col("_only")).when(F.col("_m") == 1, F.col("_here"))
        left = left.withColumn(f"_found_{name}", found).drop("_n", "_only", "_m", "_here")
    each = [F.when(F.col(f"_found_{n}").isNotNull(), F.struct(F.col(f"_found_{n}").alias("id"), F.lit(n).alias("stage"))) for n in stages]
    out = left.withColumn("_hit", F.coalesce(*each)).where("_hit is not null")
    return out.select("old_id", F.col("_hit.id").alias("new_id"), F.col("_hit.stage").alias("stage"))
