"""Near copies by SimHash and shingle sets: fingerprints, MinHash bands and rare shingles find the candidates, exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from . import simhash
from .common import components, cut, first_rows, released

#: Signatures of a set, and minima that make up each: a pair at similarity s shares none with chance (1 - s^ROWS)^BANDS, 0.00007 at 0.8.
BANDS, ROWS = 24, 5
#: Least similarity of near copies, as a fraction of whole numbers.
LEAST = (4, 5)
#: Shingles whose minima are taken at once; holders of one shingle that one task compares.
BLOCK, HOLDERS = 2048, 1024

_random = np.random.default_rng(5)
_TIMES = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
_MIX = _random.integers(0, 1 << 63, (2, BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes | None, words: int = 5) -> np.ndarray:
    """64-bit hashes of the `words`-word shingles, repeats included, A-Z lower-cased; a shorter text is one shingle, no word none."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist())), np.uint64, n)


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """The same, sorted and distinct."""
    return np.unique(shingle_hashes(text, words))


def bands(shingles: np.ndarray) -> np.ndarray:
    """The set's signatures; sets at 0.8 or more nearly always have one in common."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, (shingles[at : at + BLOCK] * _TIMES + _PLUS).min(1), out=least)
    mixed = (least.reshape(BANDS, ROWS) * _MIX[0]).sum(1, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(29))) * _MIX[1, :, 0] + _MIX[1, :, 1]


def _mapped(rows: DataFrame, words: int, of, schema: str) -> DataFrame:
    """Columns id and h of rows (id, h, t) and what `of` makes of each text's hashed shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *of([shingle_hashes(t.as_py(), words) for t in part.column(2)])], ["id", "h", *[c.split()[0] for c in schema.split(", ")]])

    return rows.mapInArrow(released(run), f"id {rows.schema['id'].dataType.simpleString()}, h long, {schema}")


def _names(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets), np.uint64, len(sets)).view(np.int64))


def _signed(hashes: list[np.ndarray]) -> list[pa.Array]:
    sets = [np.unique(h) for h in hashes]
    flat = np.concatenate([bands(s) for s in sets]).view(np.int64) if sets else np.zeros(0, np.int64)
    prints = np.fromiter(map(simhash.majority, hashes), np.uint64, len(hashes)).view(np.int64)
    return [_names(sets), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat)), pa.array(prints)]


def _packed(hashes: list[np.ndarray]) -> list[pa.Array]:
    sets = [np.unique(h) for h in hashes]
    return [_names(sets), pa.array([s.tobytes() for s in sets], pa.binary())]


def _near_prints(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b) of the sets in prints (key, fp) whose SimHash fingerprints are joined at `distance` bits or fewer.

    Sets of one fingerprint hang on the least of them, which stands for the fingerprint in the links to others.
    """
    least = cut(prints.groupBy("fp").agg(F.min("key").alias("lead"), F.count("*").alias("n")))
    same = prints.join(least.where("n > 1"), "fp").select("lead", "key")
    near = simhash.links(least.select("fp"), distance)
    x, y = (least.select(F.col("fp").alias(c), F.col("lead").alias(f"l{c}")) for c in "ab")
    pairs = near.join(x, "a").join(y, "b").select("la", "lb").toDF("lead", "key").unionByName(same).where("lead <> key")
    return cut(pairs.select(F.least("lead", "key").alias("a"), F.greatest("lead", "key").alias("b")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose sets are as similar as LEAST."""
    over, under = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(under * both >= over * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("key").alias(k), F.col("set").alias(f"s{k}")) for k in "ab")
    sizes = F.octet_length("sa"), F.octet_length("sb")
    near = under * F.least(*sizes) >= over * F.greatest(*sizes)  # no other sizes reach it
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "sa", "sb").mapInArrow(released(run), "a long, b long")


def _listed(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, root, n, token): the n shingles of each set of rows (key, root), one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                held = [np.frombuffer(x.as_py(), np.int64) for x in part.column(2)]
                sizes = np.array([len(x) for x in held], np.int64)
                whose = pa.array(np.repeat(np.arange(len(held)), sizes))
                yield pa.RecordBatch.from_arrays([part.column(0).take(whose), part.column(1).take(whose), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(held))], ["key", "root", "n", "token"])

    return rows.join(sets, "key").select("key", "root", "set").mapInArrow(released(run), "key long, root long, n long, token long")


def _candidates(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (key, root), of unlike roots: all that LEAST or more can join, and few others.

    With every set in one order, rare shingles first, the first shingle that two sets share leaves in either no fewer
    than they have in common. Shingles of one set only join nothing; `left`, the shingles from this one on, needs
    no others, as they come first. A shingle whose holders all have one root joins nothing new. Holders of one shingle
    are dealt into blocks of HOLDERS or so, and each pair of blocks is a task's work of its own.
    """
    over, under = LEAST
    tokens = _listed(rows, sets)
    held = cut(tokens.groupBy("token").agg(F.count("*").alias("holders"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("holders > 1"))
    order = W.partitionBy("key").orderBy(F.desc("holders"), F.desc("token"))
    ranked = tokens.join(held, "token").withColumn("left", F.row_number().over(order)).where((under * F.col("left") >= over * F.col("n")) & F.expr("lo <> hi"))
    blocks = F.ceil(F.col("holders") / HOLDERS).cast("int")
    ranked = cut(ranked.select("token", "key", "root", "n", "left", blocks.alias("blocks"), F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    others = ranked.select("token", *[F.col(c).alias(f"{c}2") for c in ("key", "root", "n", "left")], every.alias("i"), F.col("block").alias("j"))
    ranked = ranked.select("token", "key", "root", "n", "left", F.col("block").alias("i"), every.alias("j"))
    enough = (over + under) * F.least("left", "left2") >= over * (F.col("n") + F.col("n2"))
    return ranked.join(others, ["token", "i", "j"]).where(F.expr("key < key2 and root <> root2") & enough).select(F.col("key").alias("a"), F.col("key2").alias("b")).distinct()


def _links(crowd: DataFrame, sets: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(node, root) of the sets that pairs of LEAST or more join, of the pairs near (a, b) and all that share a signature in crowd (sig, key).

    The first round decides the pairs of near fingerprints and holds each set against two others of its signature, so a
    large group costs no pairs of all its members. The second takes the sets of signatures that are not yet one group (the rest could join nothing new) and
    finds their pairs by rare shingles, not by the signature, whose holders may be many and no near copies.
    """
    low, mixed = F.min("key"), F.min(F.col("key").bitwiseXOR(F.col("sig")))
    leaders = crowd.groupBy("sig").agg(F.array(low, mixed.bitwiseXOR(F.col("sig"))).alias("others")).select("sig", F.explode("others").alias("other"))
    ends = F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")
    tested = crowd.join(leaders, "sig").where("key <> other").select(*ends)
    tested = cut((tested if near is None else tested.unionByName(near)).distinct())
    links = cut(_verified(tested, sets))
    roots = components(links)
    rows = cut(crowd.join(roots, crowd["key"] == roots["node"], "left").select("sig", "key", F.coalesce("root", "key").alias("root")))
    apart = rows.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    rows = cut(rows.join(apart, "sig", "left_semi").select("key", "root").distinct())
    found = cut(_verified(cut(_candidates(rows, sets).join(tested, ["a", "b"], "left_anti")), sets))
    return roots if found.isEmpty() else components(links.unionByName(found))


def dedup(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs without the near copies: of texts that pairs of similarity LEAST or more join, the row of least (doc_id, xxhash64(text)) stays.

    SimHash fingerprints at 4 bits or fewer name the first pairs, signatures of minima those that such fingerprints miss;
    the similarity of the shingle sets decides on either.

    Rows go by their own text, so rows that repeat a doc_id with unlike texts all stay; of rows with equal doc_id and text
    one stays, the first as JSON. Equal sets of shingles (null and empty texts among them) are one. Rows without doc_id
    are kept as they are: there is no id to keep them by. Texts of any length are read whole; an empty table stays
    empty; other columns are passed on, whatever their names and types.
    """
    there = docs.where("doc_id is not null")
    slim = there.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("t"))
    marked = cut(_mapped(slim, words, _signed, "key long, bands array<long>, fp long"))
    firsts = cut(marked.groupBy("key").agg(F.min(F.struct("id", "h")).alias("row"), F.first("bands").alias("bands"), F.min("fp").alias("fp")))
    near = _near_prints(firsts.select("key", "fp"))
    signed = firsts.select("key", F.explode("bands").alias("sig"))
    shared = signed.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1").select("sig")
    crowd = cut(signed.join(shared, "sig", "left_semi"))
    asked = crowd.select("key").union(near.select("a")).union(near.select("b")).distinct()
    asked = firsts.join(asked, "key", "left_semi").select("row.id", "row.h")
    sets = cut(_mapped(slim.join(asked, ["id", "h"], "left_semi").select("id", "h", "t").dropDuplicates(["id", "h"]), words, _packed, "key long, set binary").select("key", "set"))
    roots = _links(crowd, sets, near)
    kept = firsts.join(roots, firsts["key"] == roots["node"], "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("row").alias("row")).select("row.id", "row.h")
    repeated = cut(marked.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select("id", "h"))
    return first_rows(there, cut(kept), repeated).unionByName(docs.where("doc_id is null"))
