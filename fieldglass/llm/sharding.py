"""Shards from a hierarchical weighted hash tree."""

from __future__ import annotations

from math import ldexp

from pyspark.sql import Column, DataFrame, functions as F

from .common import running_sum

#: Regions, racks of a region, shards of a rack.
LAYOUT = (2, 3, 4)

#: regions > racks > (shard's number, weight)
Tree = list[list[list[tuple[int, float]]]]


def tree(shards: int, layout: tuple[int, int, int] = LAYOUT) -> Tree:
    """The layout filled up to `shards`; each shard beyond it is a region of its own.

    So one more shard is one more subtree of the root: no weight inside the other regions changes.
    """
    regions, racks, each = layout
    full = [[[(r * racks + k) * each + i for i in range(each)] for k in range(racks)] for r in range(regions)]
    made = [[[(n, 1.0) for n in rack if n < shards] for rack in region if rack[0] < shards] for region in full if region[0][0] < shards]
    return made + [[[(n, 1.0)]] for n in range(regions * racks * each, shards)]


def _literal(value: list | float) -> Column:
    return F.array(*map(_literal, value)) if isinstance(value, list) else F.lit(value)


def _draw(key: Column, weights: Column, *path: Column) -> Column:
    """The child with the least -ln(u) / weight, u hashed from key, path and child.

    A child's draw depends on its own weight alone: raising it moves keys only to that child, lowering it only away from it.
    """

    def one(w: Column, i: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(len(path)), *path, i), 11) + 0.5) * F.lit(ldexp(1, -53))
        return F.struct((-F.log(u) / w).alias("draw"), i.alias("child"))

    return F.array_min(F.transform(weights, one))["child"]


def descend(rows: DataFrame, key: str, root: Tree, into: str) -> DataFrame:
    """Adds the shard of `key`: a draw among the regions, among the region's racks, among the rack's shards."""
    heavy = [[sum(w for _, w in rack) for rack in region] for region in root]
    region, rack, child = f"_{into}_region", f"_{into}_rack", f"_{into}_child"
    k = F.col(key)
    rows = rows.withColumn(region, _draw(k, _literal([sum(x) for x in heavy])))
    rows = rows.withColumn(rack, _draw(k, _literal(heavy)[F.col(region)], F.col(region)))
    rows = rows.withColumn(child, _draw(k, _literal([[[w for _, w in rack] for rack in r] for r in root])[F.col(region)][F.col(rack)], F.col(region), F.col(rack)))
    numbers = _literal([[[n for n, _ in rack] for rack in r] for r in root])
    return rows.withColumn(into, numbers[F.col(region)][F.col(rack)][F.col(child)]).drop(region, rack, child)


def shard(docs: DataFrame, shards: int = 24, layout: tuple[int, int, int] = LAYOUT) -> DataFrame:
    """A row for each row of docs: doc (struct of its columns), size, text_crc32, shard, slot, grown_shard.

    doc_id and the number of shards decide the shard; with one more (grown_shard) rows move only into the new one.
    slot counts a shard's rows from 0 without gaps, in the order of md5(doc_id), then size and checksum; of equal
    rows either may come first. A null text counts as empty; rows without id share a shard and stand there in
    the order of their checksums' digests, so they spread over the window's parts; repeated rows each have a slot; texts of
    any length are only measured and summed; columns of docs keep to the struct, whatever their names; an empty table
    gives an empty result. Nothing but numbers is shuffled if the caller selects no text.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc")).withColumn("key", F.col("doc.doc_id"))
    rows = descend(descend(rows, "key", tree(shards, layout), "shard"), "key", tree(shards + 1, layout), "grown_shard")
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    rows = rows.select(
        "doc",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "shard",
        "grown_shard",
        F.md5(F.coalesce(F.col("key").cast("string"), F.concat(F.lit("text "), F.crc32(text.cast("binary")))).cast("binary")).alias("digest"),
        F.lit(1).alias("one"),
    )
    return running_sum(rows, ["shard"], "digest", ["size", "text_crc32"], "one", "slot").withColumn("slot", F.col("slot").cast("long")).drop("one", "digest")
