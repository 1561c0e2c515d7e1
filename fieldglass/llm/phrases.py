"""Phrase collocation mining: set-oriented passes over sorted occurrence relations, a word longer each time."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

#: Lower-cases A-Z; what ends a piece becomes a full stop.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\v\f\r" else b for b in range(256))
#: Distinct words counted, and words whose numbers are remembered, in a worker before it starts afresh.
FLUSH, REMEMBERED = 200_000, 100_000
#: Words, and bytes of text, taken at once.
STEP, TEXT = 1 << 19, 4 << 20
#: Bits of a filter for each group it holds, and at most (16 MB).
BITS, MOST_BITS = 16, 1 << 27
#: Bits of a piece of the filter: the tasks make pieces, the driver only lays them side by side.
PIECE = 1 << 17
#: Parts that a language's ranking is cut into.
PARTS = 64
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def tokens(text: bytes | None) -> list[bytes]:
    """Words, lower-case, and a full stop at the end of each piece that another follows."""
    return (text or b"").translate(LOWERED).replace(b".", b" . ").split()


def number(word: bytes, salt: bytes) -> int:
    """A word's 64-bit number, as F.xxhash64(salt + word)."""
    n = xxhash.xxh64_intdigest(salt + word, 42)
    return n - (1 << 64) if n >> 63 else n


class Numbers(dict):
    """Numbers of words as they come."""

    def __init__(self, salt: bytes):
        self.salt = salt

    def __missing__(self, word: bytes) -> int:
        self[word] = n = number(word, self.salt)
        return n


def _portions(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a list or binary column holds about `most` entries in each."""
    for batch in batches:
        x = batch.column(column)
        sizes = x.value_lengths() if isinstance(x, pa.ListArray) else pc.binary_length(x)
        part = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False)) // most
        edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else [0, 0]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, count) over all texts; null languages are `und`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out():
            for lang, words in counts.items():
                words.pop(b".", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(words.values(), pa.int64())], ["lang", "word", "count"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                counts.setdefault(lang.as_py(), Counter()).update(tokens(text.as_py()))
                if sum(map(len, counts.values())) > FLUSH:
                    yield from out()
        yield from out()

    found = _texts(docs).mapInArrow(run, "lang string, word binary, count long")
    return found.groupBy("lang", "word").agg(F.sum("count").alias("f"))


def numbered(words: DataFrame) -> tuple[DataFrame, bytes]:
    """(lang, word, f, g): g an array of the word's number. Two words never share a number: if any did, all are numbered again with another salt."""
    apart = words.select("word").union(words.sparkSession.sql("select cast('.' as binary) as word")).distinct()
    for salt in (b"", *(b"%d " % k for k in range(64))):
        made = F.xxhash64(F.concat(F.lit(salt), "word"))
        if apart.groupBy(made.alias("g")).count().where("count > 1").isEmpty():
            return words.withColumn("g", F.array(made)), salt
    raise ValueError("no salt keeps the words apart")


def _mixed(groups: np.ndarray) -> np.ndarray:
    """One well-mixed 64-bit value for each row of word numbers."""
    h = np.zeros(len(groups), np.uint64)
    for column in groups.astype(np.int64).view(np.uint64).T:
        h = (h ^ column) * MIX[0]
        h ^= h >> np.uint64(32)
        h *= MIX[1]
        h ^= h >> np.uint64(29)
        h *= MIX[2]
    return h ^ (h >> np.uint64(32))


def _places(groups: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mixed(groups)
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) * MIX[0] >> np.uint64(16) & np.uint64(bits - 1)


class Filter:
    """Which groups may be frequent: a bitmap of bounded size, broadcast to the tasks. It passes every frequent group; the
    few others that it passes fall out when the longer groups are counted."""

    def __init__(self, frequent: DataFrame):
        """frequent: (lang, g, f). Languages share the map; a group that is frequent in one may pass in another."""
        bits = min(MOST_BITS, max(1 << 10, 1 << (BITS * frequent.count() - 1).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g = batch.column(0)
                if not len(g):
                    continue
                at = np.unique(np.concatenate(_places(g.flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1), bits)))
                yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(PIECE)).astype(np.int32)), pa.array((at % np.uint64(PIECE)).astype(np.int32))], ["piece", "bit"])

        def pieces(key: tuple, part: pa.Table) -> pa.Table:
            held = np.zeros(PIECE, bool)
            held[part.column("bit").to_numpy()] = True
            return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "map": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

        self.bits, self.map = bits, np.zeros(max(bits, PIECE) // 32, np.uint32)
        for piece, part in frequent.select("g").mapInArrow(run, "piece int, bit int").groupBy("piece").applyInArrow(pieces, "piece int, map binary").collect():
            self.map[piece * (PIECE // 32) :][: PIECE // 32] = np.frombuffer(part, "<u4")
        self.session = frequent.sparkSession
        self.shared = self.session.sparkContext.broadcast(self.map)

    def passes(self):
        """A function of a matrix of groups, for the tasks."""
        shared, bits = self.shared, self.bits

        def has(groups: np.ndarray) -> np.ndarray:
            held = np.ones(len(groups), bool)
            for at in _places(groups, bits):
                held &= (shared.value[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
            return held

        return has


RELATION = "lang string, word array<bigint>, adjacent array<boolean>, starts array<boolean>"


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word, adjacent and starts of all rows in one piece, and the rows' ends. The first word of a row is adjacent to none before."""
    lists = [batch.column(c) for c in (1, 2, 3)]
    word, adjacent, starts = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    ends = np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))
    return word, adjacent.astype(bool), starts.astype(bool), ends


def _extended(word: np.ndarray, adjacent: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Places where a group of `length` words begins: the merge of the groups one word shorter with the words that stand
    right behind them. Both are sorted by piece and position, so the merge is one step along the arrays."""
    at = np.flatnonzero(starts)
    at = at[at + length - 1 < len(word)]
    at = at[adjacent[at + length - 1]]
    # both shorter groups inside are frequent
    return at[starts[at + 1]] if length > 2 else at


def _groups(word: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return word[at[:, None] + np.arange(length)]


def _relation(langs, word, adjacent, starts, ends) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (word, adjacent, starts)]
    return pa.RecordBatch.from_arrays([langs, *lists], ["lang", "word", "adjacent", "starts"])


def _kept(word, adjacent, starts, ends, length: int):
    """The relation without the words that no group of `length` covers; what follows a gap is adjacent to none before."""
    covered = np.zeros(len(word), bool)
    at = np.flatnonzero(starts)
    for k in range(length):
        covered[at + k] = True
    before = np.concatenate(([False], covered[:-1])) if len(word) else covered
    counts = np.concatenate(([0], np.cumsum(covered)))
    return word[covered], (adjacent & before)[covered], starts[covered], counts[ends]


def occurrences(docs: DataFrame, salt: bytes, frequent) -> DataFrame:
    """The relation of the frequent words' occurrences: a row for each text, its words' numbers in order of piece and position.
    adjacent: the word stands right behind the one before; starts: a frequent group begins here."""
    seen = Numbers(salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, 1, TEXT):
            if len(seen) > REMEMBERED:
                seen.clear()
            stop, sizes, parts = number(b".", salt), [], []
            for text in batch.column(1):
                words = tokens(text.as_py())
                parts.append(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)))
                # a full stop is no word: it is never in the counted words
                sizes.append(len(words))
            word, ends = np.concatenate(parts) if parts else np.zeros(0, np.int64), np.cumsum(sizes, dtype=np.int64)
            starts = (word != stop) & frequent(word[:, None])
            first = np.zeros(len(word) + 1, bool)
            first[np.concatenate(([0], ends[:-1]))] = True
            yield _relation(batch.column(0), *_kept(word, ~first[:-1], starts, ends, 1))

    return _texts(docs).mapInArrow(run, RELATION)


def narrowed(relation: DataFrame, length: int, frequent) -> DataFrame:
    """The relation of groups of `length` words: those of the relation one word shorter, extended, that the frequent ones hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, 1, STEP):
            word, adjacent, starts, ends = _flat(batch)
            at = _extended(word, adjacent, starts, length)
            at = at[frequent(_groups(word, at, length))]
            starts = np.zeros(len(word), bool)
            starts[at] = True
            yield _relation(batch.column(0), *_kept(word, adjacent, starts, ends, length))

    return relation.mapInArrow(run, RELATION)


def group_counts(relation: DataFrame, length: int) -> DataFrame:
    """(lang, g, f): every group of `length` words that extends a group of the relation, counted in the tasks and then as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches, 1, STEP):
            word, adjacent, starts, ends = _flat(batch)
            at = _extended(word, adjacent, starts, length)
            langs = batch.column(0).dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)[np.searchsorted(ends, at, side="right")]
            values, place = np.unique(word, return_inverse=True)
            key, most = code.astype(np.int64), max(len(langs.dictionary), 1)
            for k in range(length):
                if most * max(len(values), 1) >= 1 << 62:  # numbered anew
                    key, most = np.unique(key, return_inverse=True)[1], len(key) + 1
                key, most = key * len(values) + place[at + k], most * max(len(values), 1)
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            parts = [pa.array(word[at[first] + k]) for k in range(length)]
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(code[first])), *parts, pa.array(counts)], ["lang", *names, "f"])

    names = [f"g{k}" for k in range(length)]
    counted = relation.mapInArrow(run, f"lang string, {', '.join(f'{n} bigint' for n in names)}, f long")
    return counted.groupBy("lang", *names).agg(F.sum("f").alias("f")).select("lang", F.array(*names).alias("g"), "f")


def scored(lengths: dict[int, DataFrame]) -> DataFrame:
    """(lang, g, a, l, r, score) of every frequent group of two words or more; lengths: (lang, g, f) of the frequent groups by length."""
    made = []
    for length in sorted(lengths)[1:]:
        rows = lengths[length].withColumnRenamed("f", "a")
        for k in range(1, length):
            for side, size, start in (("l", k, 1), ("r", length - k, k + 1)):
                part = lengths[size].select(F.col("lang").alias("_lang"), F.col("g").alias("_g"), F.col("f").alias(f"{side}{k}"))
                rows = rows.join(part, (F.col("lang") == F.col("_lang")) & (F.slice("g", start, size) == F.col("_g"))).drop("_lang", "_g")
        exact = lambda c: F.col(c).cast("decimal(19,0)")
        cuts = []
        for k in range(1, length):
            score = F.call_function("div", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), exact(f"l{k}") * exact(f"r{k}")).cast("long")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        made.append(rows.select("lang", "g", "a", F.array_min(F.array(*cuts)).alias("cut")).select("lang", "g", "a", "cut.l", "cut.r", "cut.score"))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def outer(lengths: dict[int, DataFrame], share: int) -> DataFrame:
    """(lang, g) of frequent groups that a longer one holds in `share` per cent of their occurrences or more."""
    found = None
    for length in sorted(lengths)[2:]:
        inner = F.array(*[F.slice("g", i, size) for size in range(2, length) for i in range(1, length - size + 2)])
        parts = lengths[length].select("lang", F.explode(inner).alias("g"), "f")
        found = parts if found is None else found.unionByName(parts)
    most = found.groupBy("lang", "g").agg(F.max("f").alias("most"))
    shorter = None
    for length in sorted(lengths)[1:-1]:
        rows = lengths[length].select("lang", "g", "f")
        shorter = rows if shorter is None else shorter.unionByName(rows)
    return most.join(shorter, ["lang", "g"]).where(100 * F.col("most") >= share * F.col("f")).select("lang", "g")


def first_of_each(rows: DataFrame, count: int, order: list[Column], exact: bool) -> DataFrame:
    """The first `count` rows of each lang: of each part first, then of the language. Not exact: rows that tie with the last stay too."""
    rank = F.row_number() if exact else F.rank()
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("g"), F.lit(PARTS)))
    parts = parts.withColumn("_rank", rank.over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= count).drop("_part", "_rank")
    return parts.withColumn("rank", rank.over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= count) if exact else parts


def mine(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, count: int = 2000) -> DataFrame:
    """Each lang's first `count` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the occurrences, overlaps included, of the phrase and of its two parts at the cut of least score,
    n all words of the language, score floor(10^6 a^2 / (l r)), exact. Phrases are those of `least` occurrences or more
    that no longer one holds in `share` per cent of their occurrences. Ties fall by a, then by the phrase's bytes.

    A null text counts as empty and a null lang as `und`; repeated rows each count; texts of any length are read whole;
    an empty table, or one without such phrases, gives an empty result; other columns are not read.

    A word's two neighbours never meet in one task by value: groups are counted where the texts are, and only their
    counts are shuffled, so a word or phrase of a third of all places is no hot key.
    """
    words, salt = numbered(stored(word_counts(docs)))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    lengths = {1: stored(words.where(F.col("f") >= least).select("lang", "g", "f", "word"))}
    relation = stored(occurrences(docs, salt, Filter(lengths[1]).passes()))
    for length in range(2, longest + 1):
        lengths[length] = stored(group_counts(relation, length).where(F.col("f") >= least))
        if length < longest:
            relation = stored(narrowed(relation, length, Filter(lengths[length]).passes()))
    rows = scored(lengths)
    if longest > 2:
        rows = rows.join(outer(lengths, share), ["lang", "g"], "left_anti")
    order = [F.desc("score"), F.desc("a")]
    near = stored(first_of_each(rows, count, order, exact=False))
    names = lengths[1].select("lang", F.col("g")[0].alias("id"), "word")
    spelt = near.select("lang", "g", F.posexplode("g").alias("k", "id")).join(names, ["lang", "id"])
    spelt = spelt.groupBy("lang", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("word").cast("string").alias("word")))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first_of_each(near.join(spelt, ["lang", "g"]), count, [*order, F.col("phrase")], exact=True)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
