"""Texts without case and accents as plain strings, which hash and compare by their bytes."""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Equal under it: any case, any accents, letters with strokes, ligatures and their letters.
COLLATION = "UNICODE_CI_AI"
ASCII = r"^[\t-\r -~]*\z"
PLAIN = re.compile(r"[\t-\r -~]*")


@cache
def letters() -> dict[str, str]:
    """Characters that the collation takes for ASCII ones (or for nothing), and what it takes them for; the dotless i, a letter of its own there, is an i."""
    found = {"ı": "i"}
    for line in (Path(__file__).parent / "plain_letters.txt").read_text().splitlines():
        if not line.startswith("#"):
            text, places = line.split(":")
            for part in places.split():
                first, _, last = part.partition("-")
                found |= {chr(c): bytes.fromhex(text).decode() for c in range(int(first, 16), int(last or first, 16) + 1)}
    return found


def folded(text: Column) -> Column:
    """struct(plain, other), equal where the trimmed texts are equal under the collation: ASCII in lower case where the
    text is the same as ASCII, and only for others (other scripts) the text under the collation. Null for null.

    Keys of a collation are made one at a time in a process, and aggregates sort by it; plain texts are hashed by every core.
    """
    known = letters()
    single = {c: to for c, to in known.items() if len(to) == 1} | {c: "" for c, to in known.items() if not to}
    order = sorted(single, key=lambda c: not single[c])  # translate drops those without a partner
    several = F.create_map(*[F.lit(v) for pair in known.items() if len(pair[1]) > 1 for v in pair])
    trimmed = F.trim(text)
    one = F.translate(trimmed, "".join(order), "".join(single[c] for c in order))
    two = F.array_join(F.transform(F.split(F.replace(one, F.lit("ß"), F.lit("ss")), ""), lambda c: F.coalesce(several[c], c)), "")
    plain = F.lower(F.when(trimmed.rlike(ASCII), trimmed).when(one.rlike(ASCII), one).when(two.rlike(ASCII), two))
    other = F.when(plain.isNull(), F.collate(F.replace(trimmed, F.lit("ı"), F.lit("i")), COLLATION))
    return F.when(text.isNotNull(), F.struct(plain.alias("plain"), other.alias("other")))


def plain_of(text: str) -> str | None:
    """What folded() has as `plain`, of one text."""
    single, several = _places()
    found = text.strip(" ")
    for step in (lambda x: x, lambda x: x.translate(single), lambda x: "".join(several.get(c, c) for c in x.replace("ß", "ss"))):
        found = step(found)
        if PLAIN.fullmatch(found):
            return found.lower()
    return None


@cache
def _places() -> tuple[dict[int, str], dict[str, str]]:
    known = letters()
    return {ord(c): to for c, to in known.items() if len(to) < 2}, {c: to for c, to in known.items() if len(to) > 1}


def folded_once(text: Column) -> Column:
    """folded() for a column of rows: each different text of a batch is folded once, in the workers, and an expression that
    names the key again and again does not make it again. Not for use inside lambdas of arrays."""

    @F.arrow_udf("string")
    def fold(texts: pa.Array) -> pa.Array:
        found = texts.dictionary_encode()
        return pa.array([plain_of(x) for x in found.dictionary.to_pylist()], pa.string()).take(found.indices)

    plain = fold(text)
    other = F.when(plain.isNull(), F.collate(F.replace(F.trim(text), F.lit("ı"), F.lit("i")), COLLATION))
    return F.when(text.isNotNull(), F.struct(plain.alias("plain"), other.alias("other")))
