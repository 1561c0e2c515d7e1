"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products inside a cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import components, cut

#: Rows that the centroids are fitted on; every row is assigned and compared.
SAMPLE = 20_000
#: Vectors of one label in a cell, on average; vectors, and components, that a block holds at most; vectors placed, and multiplied, at once.
CELL, BLOCK, COMPONENTS, PLACED, STRIP = 32_768, 32_768, 1 << 21, 1024, 256


def unit(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # squares of tiny or huge components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors. Far-apart seeds, so that one dense group gets one centroid."""
    rng = np.random.default_rng(seed)
    chosen = [x[rng.integers(len(x))]]
    near = x @ chosen[0]
    for _ in range(1, min(k, len(x))):
        away = np.clip(1 - near, 0, None) ** 2
        if not away.sum() > 0:
            break
        chosen.append(x[rng.choice(len(x), p=away / away.sum())])
        near = np.maximum(near, x @ chosen[-1])
    centres = np.array(chosen)
    for _ in range(rounds):
        home = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    finite = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(F.col("label").isNotNull() & e.isNotNull() & F.coalesce(finite & F.exists(e, lambda v: v != 0), F.lit(False)))


def _assign(centres: np.ndarray, least: float):
    """(label, size, id, embedding, n, home, cell, core, near): a row for its own cell and for each cell of higher number that may
    hold a partner.

    A partner y of x has |x - y|^2 <= 2 - 2 least. If y's cell is j and x's is i, y lies on j's side of the plane
    between the two centroids, so x is no farther from that plane than |x - y|: cells beyond are left out and no
    pair is lost. A pair across cells is met in the higher of the two.
    """
    far = np.sqrt(2 - 2 * least) + 1e-9
    gap = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    # any two within half the link's angle of a centroid are linked
    core = np.cos(np.arccos(least) / 2) + 1e-9

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby("size"):
                if part["size"].iat[0] != centres.shape[1]:
                    # of another length than the sample's: one cell, compared whole
                    yield part.assign(home=True, cell=-1, core=False, near=0.0)
                    continue
                for at in range(0, len(part), PLACED):
                    rows = part.iloc[at : at + PLACED]
                    dots = unit(rows["embedding"]) @ centres.T
                    home, own = dots.argmax(1), dots.max(1)
                    reach = own[:, None] - dots <= far * gap[home]
                    reach &= np.arange(len(centres)) >= home[:, None]
                    i, j = np.nonzero(reach)
                    yield rows.iloc[i].assign(home=home[i] == j, cell=j, core=(home[i] == j) & (own[i] >= core), near=dots[i, j])

    return run


def _joined(hit: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names that rows and columns bear, sorted, and the least name that each reaches by hits; equal names are one."""
    old, place = np.unique(np.concatenate((rows, columns)), return_inverse=True)
    least, far = old, np.iinfo(np.int64).max
    while True:
        r, c = least[place[: len(rows)]], least[place[len(rows) :]]
        r = np.minimum(r, np.where(hit, c, far).min(1, initial=far))
        c = np.minimum(c, np.where(hit, r[:, None], far).min(0, initial=far))
        new = least.copy()
        np.minimum.at(new, place, np.concatenate((r, c)))
        if (new == least).all():
            return old, least
        least = new


def _compare(least: float):
    """Of one pair of blocks of a cell, each row with its number of links and the least id that links in the pair reach.
    A block against itself comes once, as the right one."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        same = key[-1] == key[-2]
        left = right if same else left
        if left.empty or right.empty:
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "to": pd.Series(dtype="int64")})
        x, y = unit(left["embedding"]), unit(right["embedding"])
        ids, many = (np.concatenate([side[c].to_numpy() for side in ([right] if same else [right, left])]) for c in ("id", "n"))
        first = 0 if same else len(y)  # of the left rows
        links, names = np.zeros(len(ids), np.int64), ids.copy()
        for at in range(0, len(x), STRIP):
            hit = x[at : at + STRIP] @ y.T >= least
            if same:
                hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
            i, j = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            if not len(i):
                continue
            hit, i = hit[np.ix_(i, j)], i + at + first
            links[i] += hit @ many[j]
            if not same:
                links[j] += many[i] @ hit
            old, new = _joined(hit, names[i], names[j])
            place = np.minimum(np.searchsorted(old, names), len(old) - 1)
            names = np.where(old[place] == names, new[place], names)
        return pd.DataFrame({"id": ids, "n": links, "to": names})[links > 0]

    return run


def _blocks(placed: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparisons by (label, size, cell, i, j): a row is sent once for each block that its own is held against."""
    cell = ["label", "size", "cell"]
    # blocks: the cell's own rows outside the core against each other, and against them and the core all rows from other cells
    own, visits = F.col("home") & ~F.col("core"), ~F.col("home")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(COMPONENTS) / F.col("size"))))
    blocks = lambda which: F.ceil(F.count_if(which) / F.max(room)).cast("int")
    # a core row lies within `edge` of the centroid: nobody farther than that and the link's angle reaches it
    about = placed.groupBy(*cell).agg(F.min(F.when(F.col("core"), F.col("near"))).alias("edge"), F.greatest(F.lit(1), blocks(own)).alias("own"), F.greatest(F.lit(1), blocks(F.col("core"))).alias("cores"), blocks(visits).alias("visits"))
    rows = placed.join(about, cell)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("near"))))
    edge = F.acos(F.least(F.lit(1.0), "edge"))
    rows = rows.withColumn("meets", ~F.col("core") & F.coalesce(angle <= edge + float(np.arccos(least)) + 1e-6, F.lit(False)))
    # own blocks are numbered from 0, the visitors' follow, the core's are below 0; rows are dealt by hash
    dealt = lambda count: F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
    rows = rows.withColumn("block", F.when(own, dealt("own")).when(visits, F.col("own") + dealt("visits")).otherwise(-1 - dealt("cores")))
    none = F.array().cast("array<int>")
    span = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(none)
    outer = rows.where("not core")
    fields = [*cell, "id", "embedding", "n"]
    last, guests = F.col("own") - 1, span(F.col("own"), F.col("own") + F.col("visits") - 1)
    core_blocks = F.when(F.col("meets"), F.transform(F.sequence(F.lit(1), "cores"), lambda v: -v)).otherwise(none)
    left = outer.select(*fields, F.col("block").alias("i"), F.explode(F.concat(span(F.when(F.col("home"), F.col("block") + 1).otherwise(F.lit(0)), last), core_blocks)).alias("j"))
    right = rows.where("home").select(*fields, F.explode(F.concat(span(F.lit(0), F.when(F.col("core"), last).otherwise(F.col("block"))), guests)).alias("i"), F.col("block").alias("j"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides come from one table
    return left, right


def near_duplicates(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors of one label are linked if their cosine, in double precision, is `least` or more; every such pair is
    found. Vectors that are null, zero, of a null label or hold a null or non-finite component link with nothing
    (their own component); vectors of different lengths do not link. Equal vectors of a label are compared once
    and counted by their number. Vectors within half the link's angle of their centroid are linked with each other without a
    product, which keeps a dense group linear. Null ids keep a row with no links. An empty table gives an empty result;
    other columns of vectors are not read.
    """
    usable = cut(_usable(vectors).where("vec_id is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).withColumn("size", F.size("embedding")))
    total = usable.count()
    if total == 0:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    groups = usable.groupBy("label", "size").count().groupBy("size").agg(F.sum("count").alias("rows"), F.max("count").alias("most"))
    size, _, most = groups.orderBy(F.desc("rows"), "size").first()
    sample = usable.where(F.col("size") == size).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").toPandas()
    # only vectors of one label meet: cells are as many as its largest label needs, and a label that fits in one block is sent once
    centres = spherical_kmeans(unit(sample["embedding"]), min(max(1, most // CELL), 1024, max(1, len(sample) // 8)))

    kind = usable.schema["embedding"].dataType.simpleString()
    label = usable.schema["label"].dataType.simpleString()
    placed = cut(usable.select("label", "size", "id", "embedding", "n").mapInPandas(_assign(centres, least), f"label {label}, size int, id long, embedding {kind}, n long, home boolean, cell int, core boolean, near double"))

    cell = ["label", "size", "cell"]
    cores = placed.where("core").groupBy(*cell).agg(F.sum("n").alias("all"), F.min("id").alias("to"))
    core_links = placed.where("core").join(cores, cell).select("id", (F.col("all") - F.col("n")).alias("n"), "to")

    left, right = _blocks(placed, least)
    keys = [*cell, "i", "j"]
    crossed = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(least), "id long, n long, to long")
    found = cut(crossed.unionByName(core_links))
    twins = vectors.where("vec_id is not null").select("vec_id", "label", "embedding")
    heads = usable.select(F.col("label").alias("l"), F.col("embedding").alias("e"), "id", F.col("n").alias("copies"))
    roots = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    sums = found.groupBy("id").agg(F.sum("n").alias("links"))
    merged = heads.join(sums, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = merged.groupBy("root").agg(F.min("id").alias("component_id"))
    merged = merged.join(first, "root").select("l", "e", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    joined = twins.join(merged, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    out = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    out = out.unionByName(vectors.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
