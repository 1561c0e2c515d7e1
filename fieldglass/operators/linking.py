"""Who a text is about: names of several words as keys that ignore case and accents, the longest match, the club as a witness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from fieldglass.functions.folding import folded

from .simulation import spread

WORD = r"[\p{L}\p{M}\p{N}]+"
#: Expected minutes under which a player is fringe, and above which he is sure to play. Fixed values.
FRINGE, SURE = 45.0, 75.0
#: What makes a mention of a sure player worth a look. Fixed values.
DOUBT = ("injury", "injured", "knock", "doubt", "strain", "surgery", "out for", "ruled out", "limped", "suspended", "rested", "assessed", "scan")


def key(text: Column) -> Column:
    """What joins, groups and comparisons take for the text without case and accents. The dotless i is an i."""
    return folded(text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def dictionary(names: DataFrame) -> DataFrame:
    """(phrase, n, first, kind, entity, ambiguous) of names (name, kind, entity): a row for each different name; one that several entities bear is ambiguous."""
    parts = names.select(words(F.col("name")).alias("w"), F.struct("kind", F.col("entity").cast("string").alias("entity")).alias("of")).where(F.size("w") > 0)
    parts = parts.select(key(F.array_join("w", " ")).alias("phrase"), F.size("w").alias("n"), key(F.col("w")[0]).alias("first"), "of")
    found = parts.groupBy("phrase", "n").agg(F.min("first").alias("first"), F.min("of").alias("of"), F.max("of").alias("most"))
    return found.select("phrase", "n", "first", "of.kind", "of.entity", (F.col("of") != F.col("most")).alias("ambiguous"))


def mentions(texts: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, start, n, kind, entity, ambiguous): the names in each text, from the left, the longest of those that start together; none overlaps another.

    texts: one row for each id. names: name (any number of words), kind, entity. Only words that begin some name go on
    to be looked up, and then only as phrases of the lengths that names beginning so have: two equality joins,
    whatever the number of names. Null texts and names have no words. Texts are dealt out by id first, however few files
    hold them: a text's words are looked up and its matches put together where it lies.
    """
    known = dictionary(names)
    longest = known.agg(F.max("n")).first()[0] or 1
    spots = spread(texts.select(id_col, text_col), id_col).select(id_col, words(F.col(text_col)).alias("w"))
    spots = spots.select(id_col, F.posexplode(F.transform("w", lambda x, i: F.slice("w", i + 1, longest))).alias("start", "w"))
    begins = known.groupBy("first").agg(F.collect_set("n").alias("lengths"))  # few lengths
    spots = spots.withColumn("first", key(F.col("w")[0])).join(begins, "first").select(id_col, "start", "w", F.explode("lengths").alias("n")).where(F.size("w") >= F.col("n"))
    spots = spots.select(id_col, "start", "n", key(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ")).alias("phrase"))
    found = spots.join(known.drop("first"), ["phrase", "n"]).select(id_col, F.struct("start", (-F.col("n")).alias("less"), "kind", "entity", "ambiguous").alias("m"))
    listed = found.groupBy(id_col).agg(F.sort_array(F.collect_list("m")).alias("all"))  # a text's own matches

    @pandas_udf("array<boolean>")
    def apart(starts: pd.Series, less: pd.Series) -> pd.Series:
        """Which matches are taken one after another, each from where the last one ends (its start minus `less`); a step a match."""
        rows = []
        for firsts, lengths in zip(starts, less):
            kept, end = [], 0
            for start, n in zip(firsts.tolist(), lengths.tolist()):
                kept.append(start >= end)
                end = start - n if start >= end else end
            rows.append(kept)
        return pd.Series(rows)

    marked = listed.select(id_col, F.explode(F.arrays_zip("all", apart(F.col("all.start"), F.col("all.less")).alias("kept"))).alias("m")).where("m.kept")
    return marked.select(id_col, "m.all.start", (-F.col("m.all.less")).alias("n"), "m.all.kind", "m.all.entity", "m.all.ambiguous")


def linked(found: DataFrame, players: DataFrame, id_col: str) -> DataFrame:
    """(id_col, entity, club) of the players mentioned in texts that name their own club too; players: entity, club. Ambiguous names link nobody."""
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("entity")))
    sure = found.where(~F.col("ambiguous")).groupBy(id_col).agg(of("player").alias("players"), of("club").alias("clubs"))
    own = players.select(F.col("entity").cast("string").alias("entity"), F.col("club").cast("string").alias("club"))
    said = sure.select(id_col, F.explode("players").alias("entity"), "clubs").where(F.size("clubs") > 0)
    return said.join(own, "entity").where(F.array_contains("clubs", F.col("club"))).select(id_col, "entity", "club")


def standing(texts: DataFrame, found: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """(id_col, clubs, linked, refused, level): each text's clubs named, players linked, ambiguous names refused, and what it can be filed under."""
    said = found.groupBy(id_col).agg(F.count_distinct(F.when((F.col("kind") == "club") & ~F.col("ambiguous"), F.col("entity"))).alias("clubs"), F.count_if("ambiguous").alias("refused"))
    who = links.groupBy(id_col).agg(F.count("*").alias("linked"))
    rows = texts.select(id_col).join(said, id_col, "left").join(who, id_col, "left").fillna(0, ["clubs", "refused", "linked"])
    return rows.withColumn("level", F.when(F.col("linked") > 0, "player").when(F.col("clubs") > 0, "club").otherwise("none"))


def conflicts(links: DataFrame, texts: DataFrame, projections: DataFrame, id_col: str, text_col: str, fringe: float = FRINGE, sure: float = SURE) -> DataFrame:
    """(id_col, entity, kind, gap): texts about players who are hardly expected to play, or that doubt players who are sure to; widest gap first.

    projections: entity, minutes. Doubt is a word of DOUBT anywhere in the text.
    """
    low = F.lower(text_col)
    doubt = F.lit(False)
    for word in DOUBT:
        doubt = doubt | F.contains(low, F.lit(word))
    said = texts.select(id_col, F.coalesce(doubt, F.lit(False)).alias("doubt"))
    rows = links.join(projections.select(F.col("entity").cast("string").alias("entity"), "minutes"), "entity").join(said, id_col)
    kind = F.when(F.col("minutes") < fringe, "fringe_but_discussed").when((F.col("minutes") > sure) & F.col("doubt"), "sure_but_doubted")
    gap = F.when(F.col("minutes") < fringe, fringe - F.col("minutes")).otherwise(F.col("minutes") - sure)
    return rows.select(id_col, "entity", kind.alias("kind"), F.round(gap, 1).alias("gap")).where("kind is not null").orderBy(F.desc("gap"), id_col, "entity")
