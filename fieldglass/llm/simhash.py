"""SimHash near-duplicates found by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, cut, first_rows

BITS = 64
#: Shingles whose hashes are held at once; longer texts are summed block by block.
BLOCK = 1 << 16


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashed shingles, repeats included; of none 0."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        total += ones(hashes[at : at + BLOCK])
    return int(np.packbits(2 * total > len(hashes)).view(">u8")[0])


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, `words`-word shingles with repeats; no word at all gives 0."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        total += ones(np.array([digest(joined[i:j], 42) for i, j in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], np.uint64))
    return int(np.packbits(2 * total > n).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments: so few that of `distance` flips at most one falls into some segment."""
    count = distance // 2 + 1
    edges = [round(i * BITS / count) for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _signatures(distance: int) -> Column:
    """All one-wildcard variants: segment and wildcard's place above, the segment without that bit below."""
    made = []
    for k, (shift, width) in enumerate(segments(distance)):
        for bit in range(width):
            kept = _segment(F.col("fp"), shift, width).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            made.append(kept.bitwiseOR(F.lit(((k << 6) | bit) << 33)))
    return F.array(*made)


def _first_shared(differ: Column, distance: int) -> Column:
    """The one signature through which a pair counts, so that a pair which shares many comes out once."""
    out = F.lit(-1).cast("long")
    for k, (shift, width) in reversed(list(enumerate(segments(distance)))):
        part = _segment(differ, shift, width)
        place = F.when(part == 0, F.lit(0)).otherwise(F.bit_count(part - 1))  # of a single set bit
        out = F.when(F.bit_count(part) <= 1, F.lit(k << 6).bitwiseOR(place).cast("long")).otherwise(out)
    return out


def _flips(most: int) -> list[int]:
    """Every 64-bit mask with `most` set bits or fewer, as signed longs."""
    masks = [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(fps: DataFrame, distance: int = 4, heavy: int = 4096) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct `fp` at `distance` bits or fewer.

    Equality join on the one-wildcard signatures, each pair verified and passed once. Fingerprints of a signature
    that more than `heavy` others hold are linked without their pairs: each names every value within distance/2
    flips of it, and those that name one value, which are within `distance` of each other, hang on the least of
    them. Every pair within `distance` names a value in common, so nothing is lost.
    """
    if distance % 2 or not 2 <= distance <= 8:
        raise ValueError("distance is 2, 4, 6 or 8")
    signed = fps.select("fp", F.explode(_signatures(distance)).alias("sig"))
    crowded = cut(signed.groupBy("sig").count().where(F.col("count") > heavy).select("sig"))
    left, right = signed, signed.select(F.col("fp").alias("other"), F.col("sig").alias("sig2"))
    many = not crowded.isEmpty()
    if many:
        left = left.join(crowded, "sig", "left_anti")
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    found = left.join(right, (F.col("sig") == F.col("sig2")) & (F.col("fp") < F.col("other")) & (F.bit_count(differ) <= distance) & (F.shiftrightunsigned("sig", 33) == _first_shared(differ, distance)))
    found = found.select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if not many:
        return found
    # a pair may count through a crowded signature and share a light one too: it hangs together either way
    dense = signed.join(crowded, "sig", "left_semi").select("fp").distinct()
    named = dense.select("fp", F.explode(F.array(*map(F.lit, _flips(distance // 2)))).alias("mask"))
    named = named.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("named"))
    least = named.groupBy("named").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("named", "a")
    star = named.join(least, "named").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return found.unionByName(star)


#: Groups of more fingerprints than this, and fingerprints of more rows, are looked up from every task instead of by a shuffle.
CROWDED = 1024


def _components(marked: DataFrame, distance: int, first) -> DataFrame:
    """(fp, component) of the fingerprints in marked (fp, ...): component is the least value of the aggregate `first` in the group."""
    least = cut(marked.groupBy("fp").agg(first.alias("least")))
    roots = components(links(least.select("fp"), distance)).withColumnsRenamed({"node": "fp"})
    joined = cut(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    whole = joined.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n"))
    return _looked_up(joined, whole, "root").select("fp", "component")


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with table (key, ..., n: how many of rows have the key). Keys of more than CROWDED rows are at most a
    CROWDED-th as many as rows; where their table is small, which is checked, they are broadcast, so that no task gets a hot key."""
    table = cut(table)
    hot = table.where(F.col("n") > CROWDED)
    if not 0 < hot.count() <= 100_000:
        return rows.join(table.drop("n"), key)
    keys = F.broadcast(hot.select(key))
    cold = rows.join(keys, key, "left_anti").join(table.drop("n"), key)
    return cold.unionByName(rows.join(F.broadcast(hot.drop("n")), key).select(cold.columns))


def groups(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits), component_id (the least id it is linked to).

    Null and empty texts share the fingerprint zero and so are linked. Repeated ids and repeated rows each keep a
    row. component_id passes over null ids. Texts of any length are read whole, block by block. An empty table gives
    an empty result; other columns of docs are not read.
    """
    marked = cut(fingerprints(docs, words, id_col, text_col))
    named = _components(marked, distance, F.min("id"))
    copies = marked.groupBy("fp").agg(F.count("*").alias("n"))
    out = _looked_up(marked, named.join(copies, "fp"), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def dedup(docs: DataFrame, words: int = 5, distance: int = 4) -> DataFrame:
    """docs without the near copies: of each group the row of least (doc_id, xxhash64(text)) stays, whole and unchanged.

    Rows go by their own text, so rows that repeat a doc_id with unlike texts all stay; of rows with equal doc_id and
    text one stays, the first as JSON. Null and empty texts are copies of each other. Rows without doc_id are
    kept as they are: there is no id to keep them by. An empty table gives an empty result; other columns are passed
    on, whatever their names and types.
    """
    there = docs.where("doc_id is not null")
    slim = there.select(F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("row"), "text")
    marked = cut(fingerprints(slim, words, "row", "text"))
    kept = _components(marked, distance, F.min("id")).select("component.id", "component.h").distinct()
    repeated = cut(marked.groupBy("id.id", "id.h").agg(F.count("*").alias("n")).where("n > 1").select("id", "h"))
    return first_rows(there, cut(kept), repeated).unionByName(docs.where("doc_id is null"))
