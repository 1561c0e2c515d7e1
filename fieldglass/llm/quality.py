"""Quality rules: document statistics, base rules and boosted trees with monotonic constraints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import PART, released
from .trees import Forest, fit

#: Labelled rows that the trees are fitted on at most, by hash; every document is judged.
TRAIN_ROWS = 20_000
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Of each feature: whether quality may only fall (-1) or only rise (1) with it, or either (0).
FEATURES = {"log_words": 0, "word_length": 0, "longest_word": -1, "symbols": -1, "dup_lines": -1, "repeated": -1, "distinct": 0, "digits": -1, "upper": 0, "line_words": 0, "ended_lines": 0}
STATISTICS = f"{BASE}, {', '.join(f'{f} double' for f in FEATURES)}"


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of `size` words that are found twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled, factor = np.zeros(n, np.uint64), 1
    for k in range(size):
        rolled += h[k : k + n] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
    order = np.argsort(rolled, kind="stable")
    ranked = rolled[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    run: dict[tuple, int] = {}
    for i in order[np.concatenate((same, [False])) | np.concatenate(([False], same))].tolist():
        first = run.setdefault(tuple(words[i : i + size]), i)
        if first != i:
            hit[first] = hit[i] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += hit
    edges[size : size + n] -= hit
    return int((edges.cumsum() > 0).sum())


def statistics(text: bytes | None) -> tuple:
    text = text or b""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - len(text) + len(text.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    digits = len(text) - len(text.translate(None, b"0123456789"))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    per = max(n, 1)
    ended = sum(line.rstrip()[-1:] in (b".", b"!", b"?", b'"') for line in lines)
    return (
        n, chars, symbols, dup, repeats,
        float(np.log1p(n)), chars / per, float(max(map(len, words), default=0)), symbols / per, dup / max(len(lines), 1), repeats / per, len(set(words)) / per,
        digits / max(chars, 1), upper / max(chars, 1), n / max(len(lines), 1), ended / max(len(lines), 1),
    )


def measured(text: Column, forest: Forest | None = None) -> Column:
    """struct of the statistics of a whole text, and `score`, the trees' probability of good quality (1 without trees); a null text has no words.

    Both come from one worker, so a stage holds one for each task, not two.
    """
    names = [c.split()[0] for c in STATISTICS.split(", ")]

    def judged(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([statistics(t) for t in texts], columns=names)
        return found.assign(score=1.0 if forest is None or found.empty else forest.probability(found[list(FEATURES)].to_numpy(np.float64)))

    @released
    def rows(batches):
        for texts in batches:
            for at in range(0, len(texts), PART):
                yield judged(texts.iloc[at : at + PART])

    @pandas_udf(f"{STATISTICS}, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from rows(batches)

    return run(text.cast("binary"))


def base_failed(stats: str) -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < 20) | (100 * F.col(f"{stats}.n_repeat_words") > 30 * n)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Forest | None:
    """Trees for quality 1 against 0 from the labelled documents; None if there are not both.

    labels: doc_id, quality. Nulls are left out, repeated ids count once, with their highest quality. The sample's ids go to
    all executors: train_rows of them at most.
    """
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id").alias("h"), measured(F.col("text")).alias("s"), "_quality")
    # of copies of an id as many rows are fitted on as the bound allows
    table = rows.select("h", *[f"s.{f}" for f in FEATURES], "_quality").orderBy("h", *FEATURES).limit(train_rows).toPandas()
    y = table["_quality"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return fit(table[list(FEATURES)].to_numpy(np.float64), y, list(FEATURES.values()))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row for each row of docs: doc (struct of its columns), stats, base_failed, score, kept.

    kept is false if a base rule fails (fewer than 20 words, more than 30 % repeated), else whether the trees' score
    reaches `threshold`. Null and empty texts have no words and fail; texts of any length are measured whole; repeated rows are
    judged each; without labels of both kinds the base rules alone decide; an empty table gives an empty result; columns of
    docs with the names of results stay apart inside the struct.
    """
    forest = train(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), measured(F.col("text"), forest).alias("stats"))
    rows = rows.withColumn("base_failed", base_failed("stats")).withColumn("score", F.col("stats.score"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that the rules reject, columns unchanged."""
    return judge(docs, labels, threshold).where("kept").select("doc.*")
