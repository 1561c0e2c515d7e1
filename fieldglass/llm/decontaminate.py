"""Benchmark decontamination: Wu-Manber search over words for every window of the benchmark's items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import stored

#: Words of a window; words of a block, by which the search shifts.
WINDOW, BLOCK = 10, 3
#: Windows and bytes of item words that one worker holds; a larger benchmark is searched for in several passes.
HELD, HELD_BYTES = 100_000, 16 << 20
#: Words of a piece of an item. Pieces overlap by a window less one word, so no window is lost.
PIECE = 20_000
#: Lower-cases A-Z and turns whatever ends a word into a space.
SPACED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(SPACED).split()


class Patterns:
    """Windows of one length: how far a block of words lets the search shift, and the windows by their last and first blocks."""

    def __init__(self, size: int, found: dict[tuple[bytes, ...], set[str]]):
        self.size, self.block = size, min(BLOCK, size)
        self.skip, self.shift, self.bucket = size - self.block + 1, {}, {}
        for window, items in found.items():
            for end in range(self.block, size + 1):
                block = window[end - self.block : end]
                self.shift[block] = min(size - end, self.shift.get(block, size))
            self.bucket.setdefault(window[-self.block :] + window[: self.block], []).append((window, items))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, item ids) of every occurrence."""
        size, block, skip, shift, at = self.size, self.block, self.skip, self.shift.get, self.size
        while at <= len(text):
            last = tuple(text[at - block : at])
            step = shift(last, skip)
            if step:
                at += step
                continue
            start = at - size
            near = self.bucket.get(last + tuple(text[start : start + block]))
            if near:
                here = tuple(text[start:at])
                for window, items in near:
                    if window == here:
                        yield start, items
            at += 1


def patterns(items: list[tuple[str, list[bytes]]], size: int = WINDOW) -> list[Patterns]:
    """The tables of all windows of `items` (id, words), one for each length that occurs."""
    found: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        length = min(size, len(text))
        for at in range(len(text) - length + 1 if length else 0):
            found.setdefault(length, {}).setdefault(tuple(text[at : at + length]), set()).add(item)
    return [Patterns(length, windows) for length, windows in sorted(found.items())]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def search(text: list[bytes], tables: list[Patterns]) -> tuple[list[tuple[int, int]], list[str]]:
    """Runs of hit words and the ids of the items met, sorted."""
    runs, items = [], set()
    for table in tables:
        for start, ids in table.search(text):
            runs.append((start, start + table.size))
            items |= ids
    return merged(runs), sorted(items)


def pieces(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """(item, words, windows, bytes) of the items with words, long ones cut into overlapping pieces. An id that is null reads as the empty string."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in zip(frame["item"], frame["text"]):
                text = words(text)
                for at in range(0, max(len(text) - size + 1, 1) if text else 0, PIECE):
                    part = text[at : at + PIECE + size - 1]
                    rows.append((item, part, max(len(part) - size + 1, 1), sum(map(len, part))))
            yield pd.DataFrame(rows, columns=["item", "words", "windows", "bytes"])

    slim = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInPandas(run, "item string, words array<binary>, windows long, bytes long")


RUNS = "array<struct<start: int, end: int>>"
FOUND = f"n_words long, runs {RUNS}, items array<string>"


def searched(text: Column, items: list[tuple[str, list[bytes]]], size: int) -> Column:
    """struct(n_words, runs, items) of each text. A task builds the tables once from the items it is sent."""

    @pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = patterns(items, size)
        for texts in batches:
            rows = []
            for text in texts:
                text = words(text)
                runs, met = search(text, tables)
                rows.append((len(text), [{"start": a, "end": b} for a, b in runs], met))
            yield pd.DataFrame(rows, columns=["n_words", "runs", "items"])

    return run(text.cast("binary"))


def _union(lists: Column) -> Column:
    @pandas_udf(RUNS)
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda runs: [{"start": a, "end": b} for a, b in merged([(r["start"], r["end"]) for r in runs])])

    return run(lists)


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, item_col: str = "item_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """A row for each row of docs: doc (struct of its columns), n_words, runs (half-open runs of hit words), n_hit, items (sorted ids as strings).

    A word is hit inside any occurrence of `size` consecutive words of an item; an item of fewer words is looked for
    whole. Null and empty texts have no words and no hits; items without words are found nowhere; equal windows of
    several items count for each; repeated documents each keep their row; of an empty benchmark nothing is hit; an
    empty table gives an empty result. Texts of any length are searched whole. Columns of docs keep their names inside
    the struct, and the benchmark's other columns are not read.

    Up to `held` windows go to every worker. Beyond that the pieces are dealt into as many passes as it takes: each
    reads the texts with its own share of the windows and writes its hits alone, and they are put together by row.
    """
    parts = stored(pieces(benchmark, size, item_col, text_col))
    total = parts.agg(F.sum("windows").alias("windows"), F.sum("bytes").alias("bytes")).first()
    passes = max(1, -(-2 * (total["windows"] or 0) // held) if (total["windows"] or 0) > held else 1, -(-2 * (total["bytes"] or 0) // HELD_BYTES) if (total["bytes"] or 0) > HELD_BYTES else 1)

    def share(k: int) -> list[tuple[str, list[bytes]]]:
        rows = parts.where(F.pmod(F.xxhash64("item", "words"), F.lit(passes)) == k).select("item", "words").toPandas()
        return [(item, list(text)) for item, text in zip(rows["item"], rows["words"])]

    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    if passes == 1:
        found = whole.withColumn("found", searched(F.col("doc.text"), share(0), size))
    else:
        whole = stored(whole.withColumn("row", F.monotonically_increasing_id()))
        hits = None
        for k in range(passes):
            hit = stored(whole.select("row", searched(F.col("doc.text"), share(k), size).alias("found")).where(F.size("found.items") > 0))
            hits = hit if hits is None else hits.unionByName(hit)
        runs = F.flatten(F.collect_list("found.runs"))
        hits = hits.groupBy("row").agg(runs.alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"))
        hits = hits.select("row", _union(F.col("runs")).alias("runs"), "items")
        none = F.array().cast(RUNS)
        counted = searched(F.col("doc.text"), [], size)["n_words"]
        found = whole.join(hits, "row", "left").select("doc", F.struct(counted.alias("n_words"), F.coalesce("runs", none).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).alias("found"))
    n_hit = F.aggregate("found.runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc", "found.n_words", "found.runs", n_hit.alias("n_hit"), "found.items")


def spans(text: Column, runs: Column) -> Column:
    """Runs of words as code points of the text, end exclusive."""

    @pandas_udf(RUNS)
    def run(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for text, hit in zip(texts, runs):
            places = [m.span() for m in WORD.finditer(text)] if len(hit) else []
            out.append([{"start": places[r["start"]][0], "end": places[r["end"] - 1][1]} for r in hit])
        return pd.Series(out)

    return run(text, runs)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a window of the benchmark; nulls, repeats, clashing names and empty tables as in scan()."""
    return scan(docs, benchmark, size).where("n_hit = 0").select("doc.*")
