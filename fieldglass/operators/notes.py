"""Availability notes by their eight patterns, whole strings or nothing; what fits none stays as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import dated

#: Body parts by kind of injury, and the patterns of a note. Fixed values.
MUSCULAR = ("hamstring", "calf", "groin", "thigh", "muscle", "muscular", "quadricep")
LIGAMENT = ("knee", "ankle", "achilles", "shoulder", "wrist", "elbow")
DAY = r"(\d{1,2})\s+([A-Za-z]{3,9})"
PATTERNS = {
    "injury_dated": rf"(?i)^(.+?)\s+injury\s*-\s*Expected back\s+{DAY}\.?$",
    "injury_chance": r"(?i)^(.+?)\s+injury\s*-\s*(\d{1,3})%\s+chance of playing\.?$",
    "injury_undated": r"(?i)^(.+?)\s+injury\s*-\s*Unknown return date\.?$",
    "suspended_until": rf"(?i)^Suspended until\s+{DAY}\.?$",
    "loan_out": r"(?i)^Has joined\s+(.+?)\s+on loan.*$",
    "transfer_out": r"(?i)^Has joined\s+(.+?)\s+permanently\.?$",
    "returned_to": r"(?i)^Has returned to\s+(.+?)\.?$",
    "free_agent": r"(?i)^Has departed the club as a free agent\.?$",
}
EXITS = {"loan_out": "loan", "transfer_out": "transfer", "returned_to": "transfer", "free_agent": "free_agent"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parsed(notes: DataFrame, text: str = "news", added: str = "added", muscular: tuple[str, ...] = MUSCULAR, ligament: tuple[str, ...] = LIGAMENT) -> DataFrame:
    """notes with pattern, part, injury, chance, back (fit again), until (banned), exit, club and residual.

    The first pattern that the whole note fits counts. A date has no year: the one of `added`, or the next if that would
    be more than sixty days before it; without `added`, or if there is no such day, it is null. A note that fits
    none has its text as residual; empty and null notes have neither. injury is muscular, ligament or unspecified by the
    part's words; callers may give lists of their own.
    """
    c = F.trim(text)
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(c.rlike(pattern), name).otherwise(kind)
    of = lambda name, group: F.regexp_extract(c, PATTERNS[name], group)
    pick = lambda cases: F.coalesce(*[F.when(F.col("pattern") == name, of(name, group)) for name, group in cases.items()])
    words = F.split(F.lower("part"), "[^a-z]+")
    has = lambda group: F.arrays_overlap(words, F.array(*map(F.lit, group)))

    def date(name: str, first: int) -> Column:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.lower(of(name, first + 1)), 1, 3)).cast("int")
        return F.when((F.col("pattern") == name) & F.col(added).isNotNull(), dated(of(name, first).try_cast("int"), month, F.col(added)))

    rows = notes.withColumn("pattern", kind)
    rows = rows.withColumn("part", F.lower(pick({"injury_dated": 1, "injury_chance": 1, "injury_undated": 1})))
    injury = F.when(F.col("part").isNotNull(), F.when(has(muscular), "muscular").when(has(ligament), "ligament").otherwise("unspecified"))
    leaving = F.lit(None).cast("string")
    for name, label in EXITS.items():
        leaving = F.when(F.col("pattern") == name, label).otherwise(leaving)
    return rows.withColumns({
        "injury": injury, "chance": pick({"injury_chance": 2}).try_cast("int"), "back": date("injury_dated", 2), "until": date("suspended_until", 1), "exit": leaving,
        "club": pick({"loan_out": 1, "transfer_out": 1, "returned_to": 1}), "residual": F.when(F.col("pattern").isNull() & (c != ""), F.col(text)),
    })
