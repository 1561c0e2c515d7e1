"""LM scoring: Brown class-based bigrams with exchange clustering."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, stored

#: Most frequent words, which sweep after sweep exchange between the classes; classes; sweeps. Every other word then
#: takes the class of its own gain.
CORE, CLASSES, SWEEPS = 4096, 64, 6
#: Words whose counts and classes every worker holds (the most frequent); the others' come by a join.
HELD = 1 << 18
#: Smoothing: added to each word's count in its class; weight of the class's own frequency in a transition.
ALPHA, BETA = 0.5, 20.0
#: The end of a document. No word holds a space.
END = b" "
#: Counts in a worker before they are passed on.
FLUSH = 400_000
#: Documents, or words, taken at once.
STEP = 512


def tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


def held_out(doc_id: Column) -> Column:
    """Every seventh id, by checksum; rows without id are learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _step(count: str) -> Column:
    """Counts in steps of a sixteenth of a doubling."""
    return F.floor(16 * F.log2(count))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, count) over all rows of `texts` (t binary); ends are counted as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "count"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                counts.update(tokens(text.as_py()))
                if len(counts) > FLUSH:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


class Places(dict):
    """Word to place among the held words; -1 for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Lexicon:
    """The held words: place 0 is the end, then by falling count. `least`: the step of counts from which words are held."""

    words: Places
    counts: np.ndarray
    least: int


def lexicon(counts: DataFrame, held: int = HELD) -> Lexicon:
    """The words of the highest counts, `held` at most, whatever the corpus.

    A histogram of counts gives the least step at which they fit, so the driver gets those words and no others; words
    of one step are in or out together.
    """
    words = counts.where(F.col("word") != F.lit(END)).withColumn("step", _step("count"))
    least, room = 1 << 20, held
    for step, n in words.groupBy("step").agg(F.count("*")).orderBy(F.desc("step")).collect():
        if (room := room - n) < 0:
            break
        least = step
    top = words.where(F.col("step") >= least).select("word", "count").toPandas()
    top["word"] = top["word"].map(bytes)
    top = top.sort_values(["count", "word"], ascending=[False, True])
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.sum("count")).first()[0] or 0
    return Lexicon(Places({w: i for i, w in enumerate([END, *top["word"]])}), np.concatenate(([ends], top["count"].to_numpy(np.int64))), least)


def encoded(docs: DataFrame, known) -> DataFrame:
    """(id, key, out, ids, rares) of each row of docs (id, t, out): the one pass that cuts texts into words for the model.

    key names a row's id and text in 16 bytes. ids: 32-bit places of the held words in turn; -1 - k stands for the k-th
    of rares, the text's other words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value.words.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part, ids, rares = batch.slice(at, STEP), [], []
                for text in part.column(3):
                    words = tokens(text.as_py())
                    found, others = np.fromiter(map(place, words), np.int32, len(words)), {}
                    for i in np.nonzero(found < 0)[0].tolist():
                        found[i] = ~others.setdefault(words[i], len(others))
                    ids.append(found.tobytes())
                    rares.append(list(others))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, pa.binary()), pa.array(rares, pa.list_(pa.binary()))], ["id", "key", "out", "ids", "rares"])

    named = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")).cast("binary"), F.lit(" ").cast("binary"), F.coalesce("t", F.lit(b"")))
    rows = docs.select("id", F.unhex(F.md5(named)).alias("key"), "out", "t")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key binary, out boolean, ids binary, rares array<binary>")


def _sequence(ids: pa.Array) -> np.ndarray:
    """The places of documents one after the other. Each ends with an end, so each starts after one."""
    return np.concatenate([np.zeros(1, np.int32), *[np.frombuffer(x.as_buffer(), np.int32) for x in ids]])


def _counted(rows: DataFrame, keys, base: int, names: tuple[str, str]) -> DataFrame:
    """Sums of the whole-number keys that `keys` makes of a stretch of places, taken apart by `base` into two names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0

        def out():
            found, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((found // base).astype(np.int32)), pa.array((found % base).astype(np.int32)), pa.array(n.astype(np.int64))], [*names, "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                parts.append(keys(_sequence(batch.column(0).slice(at, STEP))))
                waiting += len(parts[-1])
                if waiting > 3_000_000:
                    yield out()
                    parts, waiting = [], 0
        if parts:
            yield out()

    return rows.select("ids").mapInArrow(run, f"{names[0]} int, {names[1]} int, n long").groupBy(*names).agg(F.sum("n").alias("n"))


def core_pairs(rows: DataFrame, core: int = CORE) -> DataFrame:
    """(a, b, n): how often core word b follows core word a, by place."""

    def keys(ids: np.ndarray) -> np.ndarray:
        a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
        both = (a >= 0) & (a <= core) & (b >= 0) & (b <= core)
        return a[both] * (core + 1) + b[both]

    return _counted(rows, keys, core + 1, ("a", "b"))


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(before: np.ndarray, after: np.ndarray, classes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One sweep: each word in turn, most frequent first, leaves its class for the one that gains the most mutual information.

    before[u, c], after[u, c]: how often class c stands before and after word u. table[c, d]: pairs of classes; it
    follows every move. The last class is the end's and takes no other.
    """
    classes, table = classes.copy(), table.astype(float)
    for u in np.argsort(-before.sum(1), kind="stable"):
        prev, then = before[u].astype(float), after[u].astype(float)
        if not prev.any() and not then.any():
            continue
        own = classes[u]
        table[own] -= then
        table[:, own] -= prev
        np.maximum(table, 0, out=table)
        rows, columns = table.sum(1), table.sum(0)
        gain = (_phi(table + then) - _phi(table)).sum(1) + (_phi(table.T + prev) - _phi(table.T)).sum(1)
        gain -= _phi(rows + then.sum()) - _phi(rows) + _phi(columns + prev.sum()) - _phi(columns)
        gain[-1] = -np.inf
        to = int(gain.argmax()) if gain.max() > gain[own] + 1e-9 else own
        table[to] += then
        table[:, to] += prev
        classes[u] = to
    return classes


def cluster(pairs: DataFrame, size: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each core word by place, pairs of classes). The end, place 0, has the last class to itself.

    Between sweeps Spark sums the pairs anew under the current classes: core words times classes rows, whatever the corpus.
    """
    spark = pairs.sparkSession
    own = np.arange(size) % (classes - 1)
    own[0] = classes - 1

    def neighbours(of: str, other: str) -> np.ndarray:
        named = spark.createDataFrame([(i, int(c)) for i, c in enumerate(own)], "place int, class int")
        got = pairs.join(F.broadcast(named), pairs[other] == named["place"]).groupBy(of, "class").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros((size, classes), np.int64)
        out[got[of], got["class"]] = got["n"]
        return out

    for _ in range(sweeps):
        before, after = neighbours("b", "a"), neighbours("a", "b")
        table = np.zeros((classes, classes))
        np.add.at(table, own, after)
        before[0] = after[0] = 0
        new = exchange(before, after, own, table)
        moved, own = (new != own).sum(), new
        if not moved:
            break
    table = np.zeros((classes, classes))
    np.add.at(table, own, neighbours("a", "b"))
    return own, table


def choose(codes: np.ndarray, n: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word the class that gains the most mutual information; equal gains go to the lower class.

    codes and n: the words' neighbours and their counts, word after word from `starts`: class d after the word is code d,
    class d before it is CLASSES + d. As in the model's transitions, BETA of the average are added to each class's
    neighbours; else the least class would draw every rare word.
    """
    total = max(table.sum(), 1.0)
    after, before = table + BETA * table.sum(0) / total, table.T + BETA * table.sum(1) / total
    cells = np.concatenate([after.T, before.T])[codes]
    gain = np.add.reduceat(_phi(cells + n[:, None]) - _phi(cells), starts)
    for lines, side in ((after, codes < len(table)), (before, codes >= len(table))):
        all_, own = lines.sum(1), np.add.reduceat(np.where(side, n, 0), starts)[:, None]
        gain -= _phi(all_ + own) - _phi(all_)
    gain[:, -1] = -np.inf
    return gain.argmax(1)


def chosen(counts: DataFrame, name: str, table: np.ndarray) -> DataFrame:
    """(name, class, near) of the words in counts (name, code, n); near: their codes and counts, 2 * CLASSES at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                codes, n = (x.to_numpy() for x in part.column(1).flatten().flatten())
                starts = np.concatenate(([0], np.cumsum([len(x) for x in part.column(1)])[:-1])).astype(np.int64)
                best = choose(codes, n.astype(float), starts, table)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), part.column(1)], ["name", "class", "near"])

    near = counts.groupBy(F.col(name).alias("name")).agg(F.collect_list(F.struct("code", "n")).alias("near"))
    return near.mapInArrow(run, f"name {near.schema['name'].dataType.simpleString()}, class int, near array<struct<code:int,n:bigint>>")


def held_classes(rows: DataFrame, core: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """The class of every held word: the core's own, the others' by the core words next to them; without any, the commonest class."""

    def keys(ids: np.ndarray) -> np.ndarray:
        # the class of a core word's place, else -1
        classes = np.where((ids >= 0) & (ids < len(core)), core[np.clip(ids, 0, len(core) - 1)], -1).astype(np.int64)
        loose, places = ids >= len(core), ids.astype(np.int64) * (2 * len(table))
        after = loose[:-1] & (classes[1:] >= 0)
        before = loose[1:] & (classes[:-1] >= 0)
        return np.concatenate([places[:-1][after] + classes[1:][after], places[1:][before] + len(table) + classes[:-1][before]])

    found = chosen(_counted(rows, keys, 2 * len(table), ("place", "code")), "place", table).select("name", "class").toPandas()
    known = np.concatenate((core[1:], found["class"].to_numpy(np.int64)))
    out = np.full(size, np.bincount(known, minlength=1).argmax(), np.int64)
    out[: len(core)] = core
    out[found["name"].to_numpy(np.int64)] = found["class"]
    return out


def loose_ends(rows: DataFrame, classes) -> DataFrame:
    """What the words that are not held take part in: (key, out, word, other, left, right, n).

    word alone: n times between held words of the classes left and right (-1: not held). word and other: other follows
    word. Rows without word count transitions between classes of held words in the documents learnt from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = classes.value.astype(np.int32)
        moves = np.zeros((CLASSES, CLASSES), np.int64)
        kinds = (pa.binary(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
        names = ["key", "out", "word", "other", "left", "right", "n"]
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part, found = batch.slice(at, STEP), []
                for key, out, ids, rares in zip(*(part.column(i) for i in range(4))):
                    ids = np.frombuffer(ids.as_buffer(), np.int32)
                    own = np.where(ids >= 0, held[np.maximum(ids, 0)], -1)
                    left = np.concatenate((held[:1], own[:-1]))
                    if not out.as_py():
                        both = (left >= 0) & (own >= 0)
                        np.add.at(moves, (left[both], own[both]), 1)
                    gone = np.nonzero(ids < 0)[0]
                    if not len(gone):
                        continue
                    key, out, rares = key.as_py(), out.as_py(), rares.as_py()
                    seen = Counter(zip((~ids[gone]).tolist(), left[gone].tolist(), own[gone + 1].tolist()))
                    found += [(key, out, rares[w], None, x, y, n) for (w, x, y), n in seen.items()]
                    double = gone[own[gone + 1] < 0]
                    seen = Counter(zip((~ids[double]).tolist(), (~ids[double + 1]).tolist()))
                    found += [(key, out, rares[w], rares[v], -1, -1, n) for (w, v), n in seen.items()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)
        a, b = np.nonzero(moves)
        none = [None] * len(a)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, none, a, b, moves[a, b]), kinds)], names)

    return rows.select("key", "out", "ids", "rares").mapInArrow(run, "key binary, out boolean, word binary, other binary, left int, right int, n long")


@dataclass
class Model:
    """The lexicon, its classes, log10 transitions, and per class the log10 of what a word's count is divided by. Unseen words are of class `unseen`, which has the most words seen once."""

    known: Lexicon
    classes: np.ndarray
    transitions: np.ndarray
    divisor: np.ndarray
    base_divisor: float
    train_tokens: int
    unseen: int


def train(rows: DataFrame, counts: DataFrame, known: Lexicon, core: int = CORE) -> tuple[Model, DataFrame, DataFrame, DataFrame]:
    """The model; (word, count, class) of the words that are not held; loose_ends; (key, c, d, n) of their transitions among themselves.

    rows: encoded. Classes and transitions come from the documents that are not held out.
    """
    spark = rows.sparkSession
    size, learnt = min(core + 1, len(known.counts)), rows.where("not out")
    own, table = cluster(cut(core_pairs(learnt, core)), size)
    classes = held_classes(learnt, own, table, len(known.counts))
    loose = stored(loose_ends(rows, spark.sparkContext.broadcast(classes)))
    single = loose.where("not out and word is not null and other is null")
    sides = F.explode(F.array(F.struct(F.col("right").alias("code"), "n"), F.struct(F.when(F.col("left") >= 0, F.col("left") + CLASSES).otherwise(-1).alias("code"), "n")))
    near = single.select("word", sides.alias("s")).select("word", "s.code", "s.n").where("code >= 0").groupBy("word", "code").agg(F.sum("n").alias("n"))
    placed = stored(chosen(near, "word", table))
    others = counts.where((_step("count") < known.least) & (F.col("word") != F.lit(END))).join(placed.select(F.col("name").alias("word"), "class"), "word", "left")
    others = stored(others.select("word", "count", "class"))
    # words not seen in training are most like those seen once
    once = np.bincount(classes[1:][known.counts[1:] == 1], minlength=CLASSES)
    for c, words in others.where("count = 1 and class is not null").groupBy("class").count().collect():
        once[c] += words
    unseen = int(once.argmax())
    others = others.fillna(unseen, ["class"])
    named = others.select(F.col("word").alias("w"), F.col("class").alias("k"))
    double = loose.where("other is not null").join(named, F.col("word") == F.col("w"), "left").select("key", "out", "other", "n", F.coalesce("k", F.lit(unseen)).alias("c"))
    double = stored(double.join(named, F.col("other") == F.col("w"), "left").select("key", "out", "c", F.coalesce("k", F.lit(unseen)).alias("d"), "n"))

    table = np.zeros((CLASSES, CLASSES))

    def add(found: DataFrame) -> None:
        for a, b, n in found.groupBy("a", "b").agg(F.sum("n")).collect():
            table[a, b] += n

    add(loose.where("word is null").select(F.col("left").alias("a"), F.col("right").alias("b"), "n"))
    add(double.where("not out").select(F.col("c").alias("a"), F.col("d").alias("b"), "n"))
    codes = placed.select("class", F.explode("near").alias("s")).select("class", "s.code", "s.n")
    add(codes.where(F.col("code") < CLASSES).select(F.col("class").alias("a"), F.col("code").alias("b"), "n"))
    add(codes.where(F.col("code") >= CLASSES).select((F.col("code") - CLASSES).alias("a"), F.col("class").alias("b"), "n"))

    n, v = np.bincount(classes, known.counts, CLASSES), np.bincount(classes, minlength=CLASSES).astype(float)
    for c, words, total in others.groupBy("class").agg(F.count("*"), F.sum("count")).collect():
        n[c] += total
        v[c] += words
    total, kinds = int(n.sum()), int(v.sum())
    v[unseen] += 1  # one more word, never seen
    divisor = np.log10(n + ALPHA * np.maximum(v, 1))
    # each class can follow any: even one that never occurs has a share
    share = (table.sum(0) + 1) / (table.sum() + len(table))
    transitions = np.log10((table + BETA * share) / (table.sum(1, keepdims=True) + BETA))
    return Model(known, classes, transitions, divisor, float(np.log10(total + kinds + 1)), total, unseen), others, loose, double


def score(rows: DataFrame, model: Model, others: DataFrame, loose: DataFrame, double: DataFrame) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each of the encoded rows.

    Workers score the held words and the transitions among them; the other words' parts come by joins with their
    counts and classes. Rows of equal id and text are summed together and then told apart again, so repeated rows
    each get the one score.
    """
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        log_held, log_base = np.log10(m.known.counts + ALPHA), np.log10(m.known.counts + 1.0)
        own_held, n_held = log_held - m.divisor[m.classes], (m.known.counts > 0).astype(np.int64)
        flat, k = m.transitions.ravel(), len(m.divisor)
        for batch in batches:
            found = []
            for ids in batch.column(1):
                ids = np.frombuffer(ids.as_buffer(), np.int32)
                inside = ids[ids >= 0]
                own = np.where(ids >= 0, m.classes[np.maximum(ids, 0)], -1)
                left = np.concatenate((m.classes[:1], own[:-1]))
                both = (left >= 0) & (own >= 0)
                found.append((len(ids), int(n_held[inside].sum()), float(log_base[inside].sum()) - len(ids) * m.base_divisor, float(own_held[inside].sum() + flat[left[both] * k + own[both]].sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]], ["key", "n_tokens", "known", "base", "score"])

    texts = rows.select("key", "ids").mapInArrow(run, "key binary, n_tokens long, known long, base double, score double")
    moves = F.split(F.lit(",".join(map(repr, model.transitions.ravel().tolist()))), ",").cast("array<double>")
    divisors = F.split(F.lit(",".join(map(repr, model.divisor.tolist()))), ",").cast("array<double>")
    move = lambda a, b: F.when((a >= 0) & (b >= 0), F.get(moves, a * CLASSES + b)).otherwise(0.0)
    words = others.select(F.col("word").alias("w"), F.col("count").alias("c"), F.col("class").alias("k"))
    single = loose.where("word is not null and other is null").join(words, F.col("word") == F.col("w"), "left")
    single = single.select("key", "n", "left", "right", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("k", F.lit(model.unseen)).alias("k"))
    each = F.log10(F.col("c") + ALPHA) - F.get(divisors, F.col("k")) + move(F.col("left"), F.col("k")) + move(F.col("k"), F.col("right"))
    none = F.lit(None).cast("long")
    single = single.select("key", none.alias("n_tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10(F.col("c") + 1.0)).alias("base"), (F.col("n") * each).alias("score"))
    among = double.select("key", none.alias("n_tokens"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("n") * move(F.col("c"), F.col("d"))).alias("score"))
    whole = texts.unionByName(single).unionByName(among).groupBy("key").agg(F.count("n_tokens").alias("copies"), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("known", "base", "score")])
    whole = whole.select("key", "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"), *[(F.col(c) / F.col("copies")).alias(into) for c, into in (("base", "base_score"), ("score", "score"))])
    return rows.select("id", "key").join(whole, "key").drop("key")


def learn_and_score(docs: DataFrame, held: int = HELD, core: int = CORE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    Learns from the rows that are not held out and scores all. Null and empty texts are one end; repeated rows and
    repeated ids each keep a row, and rows without id are learnt from; words of equal count are held or not together, so
    ties do not depend on the partitions; an empty table gives an empty result; other columns of docs, whatever their
    names, are not read.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("t"), held_out(F.col("doc_id")).alias("out"))
    counts = stored(word_counts(rows.where("not out").select("t")))
    known = lexicon(counts, held)
    texts = stored(encoded(rows, docs.sparkSession.sparkContext.broadcast(known)))
    model, *tables = train(texts, counts, known, core)
    scored = score(texts, model, *tables)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
