"""Secret scans: keyword prefilter, anchored patterns near its hits, embedded checksums."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import PART, released

#: Kinds in the order in which spans of one start stand.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CHECKED = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.(eyJ[A-Za-z0-9_-]{8,})\.[A-Za-z0-9_-]{8,}")
JWT_PART = re.compile(r"[A-Za-z0-9_-]*")
#: Keyword, in lower case, to the kinds whose patterns start there. Fixed values.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def checksum(payload: str) -> str:
    """Six base-62 digits of the payload's CRC-32, as these tokens end in."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _valid_header(part: str) -> bool:
    """Whether a token's first part is a JSON header that names its algorithm."""
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind: code points, end exclusive.

    Each pattern is tried only where a keyword stands and, within a kind, not inside the kind's last match; runs of
    hex digits have no keyword and are looked for directly. A match that is too short or fails its checksum goes,
    but later matches still start after it.
    """
    text = text or ""
    low = text.lower()
    if len(low) != len(text):  # some capitals grow
        low = text.translate(FOLD)
    hits: dict[str, list[int]] = {}
    for last, (size, kind) in automaton().iter(low):
        hits.setdefault(kind, []).append(last - size + 1)
    found = []
    for kind, starts in hits.items():
        free = 0
        for at in sorted(starts):
            if at < free:
                continue
            m = (ASSIGN if kind == "assign" else ACCESS if kind == "access" else JWT if kind == "jwt" else CHECKED[kind]).match(text, at)
            if not m:
                if kind == "jwt":  # what follows this part fails any other start in it as well
                    free = JWT_PART.match(text, at).end()
                continue
            free = m.end()
            if kind == "assign":
                good = len(m[2]) >= 8
            elif kind == "access":
                good = len(m[0]) >= 16
            elif kind == "jwt":
                good = _valid_header(m[1])
            else:
                good = checksum(m[1]) == m[2]
            if good:
                found.append((at, free, kind))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scanned(text: Column) -> Column:
    """struct(n_assign, n_access, n_hex, base, spans): counts and kind:start:end lists."""

    def row(text: str | None) -> tuple:
        found = spans(text)
        base = [s for s in found if s[2] in BASE_KINDS]
        return (*[sum(s[2] == k for s in base) for k in BASE_KINDS], joined(base), joined(found))

    @released
    def counted(batches):
        for texts in batches:
            for at in range(0, len(texts), PART):
                yield pd.DataFrame([row(t) for t in texts.iloc[at : at + PART]], columns=["n_assign", "n_access", "n_hex", "base", "spans"])

    @pandas_udf("n_assign long, n_access long, n_hex long, base string, spans string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from counted(batches)

    return run(text)


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc (struct of its columns) and found (counts and spans).

    Null and empty texts have no spans; a text of any length is scanned once, in time that grows with its length; of
    spans that start together the kinds' order decides; repeated rows each get their row; an empty table gives an
    empty result; columns of docs named found or doc stay apart inside the struct.
    """
    return docs.select(F.struct(*docs.columns).alias("doc"), scanned(F.col("text")).alias("found"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by `mark`, overlapping spans by one; n_chars follows where a text changes. No row goes.

    Null texts stay null and empty ones empty; repeated rows each stay; an empty table gives an empty result; other
    columns are passed on whatever their names.
    """

    def clean(text: str | None) -> str | None:
        if text is None or not (found := spans(text)):
            return text
        out, at = [], 0
        for a, b, _ in found:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:]

    @released
    def cleaned_texts(batches):
        for texts in batches:
            for at in range(0, len(texts), PART):
                yield texts.iloc[at : at + PART].map(clean, na_action=None)

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from cleaned_texts(batches)

    cleaned = docs.withColumn("text", run("text"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cleaned
