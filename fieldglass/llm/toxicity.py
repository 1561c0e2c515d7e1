"""Toxicity by a classifier chain of linear models over words."""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

#: Labelled documents that the models are fitted on at most, by hash; every document is scored.
TRAIN_ROWS = 6_000
#: Words of a model at most, folds, penalty, rounds.
WORDS, FOLDS, PENALTY, ROUNDS = 2048, 3, 0.02, 200
#: Bytes of the beginnings of words that count as words too.
BEGINNINGS = (4, 5, 6, 7)
#: ASCII letters to lower case, ASCII punctuation to spaces.
_CLEAN = bytes.maketrans((string.ascii_uppercase + string.punctuation).encode(), (string.ascii_lowercase + " " * len(string.punctuation)).encode())


def words_of(text: bytes | None) -> np.ndarray:
    """Sorted 32-bit hashes of the distinct words of a whole text and of their beginnings, for words that come with many endings."""
    found = set((text or b"").translate(_CLEAN).split())
    long = [w for w in found if len(w) > BEGINNINGS[0]]
    for n in BEGINNINGS:
        found.update([w[:n] for w in long])
    return np.unique(np.fromiter(map(zlib.crc32, found), np.uint32, len(found)))


@dataclass
class Linear:
    """Weights of some words, of the earlier categories' log odds, and an offset."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chain: np.ndarray = field(default_factory=lambda: np.zeros(0))
    offset: float = 0.0

    def probability(self, docs: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        raw = np.full(len(docs), self.offset)
        if len(self.words):
            sizes = np.fromiter(map(len, docs), np.int64, len(docs))
            every = np.concatenate([*docs, np.zeros(0, np.uint32)])
            at = np.minimum(np.searchsorted(self.words, every), len(self.words) - 1)
            hit = self.words[at] == every
            raw += np.bincount(np.repeat(np.arange(len(docs)), sizes)[hit], self.weights[at[hit]], len(docs))
        if len(self.chain):
            raw += log_odds(earlier) @ self.chain
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Sample:
    """Which words stand in which documents: places in the sorted names, document by document."""

    n: int
    names: np.ndarray
    rows: np.ndarray
    column: np.ndarray

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Sample:
        rows = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
        every = np.concatenate([*docs, np.zeros(0, np.uint32)])
        names, seen = np.unique(every, return_counts=True)
        names = names[seen >= 3]  # rarer ones say nothing
        at = np.minimum(np.searchsorted(names, every), max(len(names) - 1, 0))
        hit = names[at] == every if len(names) else np.zeros(len(every), bool)
        return cls(len(docs), names, rows[hit], at[hit].astype(np.int32))

    def only(self, columns: np.ndarray) -> Sample:
        place = np.full(len(self.names), -1, np.int32)
        place[columns] = np.arange(len(columns))
        keep = place[self.column] >= 0
        return Sample(self.n, self.names[columns], self.rows[keep], place[self.column[keep]])

    def best(self, y: np.ndarray, use: np.ndarray, count: int) -> Sample:
        """Only the `count` words that tell the classes apart best among the documents in use."""
        size = len(self.names)
        inside = use[self.rows] > 0
        seen = np.bincount(self.column[inside], minlength=size)
        hits = np.bincount(self.column[inside & (y[self.rows] > 0)], minlength=size)
        share = (y * use).sum() / use.sum()
        strength = np.where(seen >= 3, (hits - seen * share) ** 2 / np.maximum(seen * share * (1 - share), 1e-9), 0)
        return self.only(np.sort(np.argsort(-strength, kind="stable")[:count]))


def fit_linear(sample: Sample, y: np.ndarray, use: np.ndarray, earlier: np.ndarray, words: int = WORDS, penalty: float = PENALTY, rounds: int = ROUNDS) -> Linear:
    """Logistic regression on the documents in use (0 or 1): an L1 penalty, penalty / sqrt(rows), picks words out of the `words` best;
    then the picked ones are fitted anew with a tenth of it, so that they aren't held down by what left out the others."""
    n = int(use.sum())
    if not 0 < (ones := (y * use).sum()) < n:
        return Linear(offset=40.0 if n and ones else -40.0, chain=np.zeros(earlier.shape[1]))
    few = sample.best(y, use, words)
    weights, _ = _descend(few, y, use, earlier, penalty / np.sqrt(n), rounds)
    few = few.only(np.nonzero(weights[: len(few.names)])[0])
    weights, k = _descend(few, y, use, earlier, penalty / 10 / np.sqrt(n), rounds)
    return Linear(few.names, weights[:k], weights[k:-1], float(weights[-1]))


def _descend(sample: Sample, y: np.ndarray, use: np.ndarray, earlier: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, int]:
    """Accelerated proximal steps: weights of words, of the earlier categories, offset; and the number of words."""
    n, k, extra = sample.n, len(sample.names), log_odds(earlier)
    forth = lambda z: (np.bincount(sample.rows, z[:k][sample.column], n) + extra @ z[k:-1] + z[-1]) * use
    back = lambda r: np.concatenate((np.bincount(sample.column, r[sample.rows], k), extra.T @ r, [r.sum()]))
    z = np.ones(k + extra.shape[1] + 1)
    for _ in range(12):  # the largest curvature bounds the step
        z = back(forth(z))
        top = np.linalg.norm(z)
        z /= top
    size = use.sum()
    step, share = 4 * size / (1.1 * top), (y * use).sum() / size
    at, momentum = np.zeros(len(z)), 1.0
    at[-1] = np.log(share / (1 - share))
    ahead = at.copy()
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-np.clip(forth(ahead), -40, 40))) - y) * use / size
        new = ahead - step * back(r)
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, at, momentum = new + (momentum - 1) / after * (new - at), new, after
    return at, k


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """One model for each column of labels, in order; each sees the words and the earlier columns' probabilities.

    For training those are out of fold: from models fitted without the document's fold, so that a later model
    doesn't learn to trust the earlier ones more than it can on new documents.
    """
    models, earlier, sample, everyone = [], np.zeros((len(docs), 0)), Sample.of(docs), np.ones(len(docs))
    for c in range(labels.shape[1]):
        y = labels[:, c]
        models.append(fit_linear(sample, y, everyone, earlier))
        if c + 1 < labels.shape[1]:
            out = np.zeros(len(docs))
            for k in np.unique(folds):
                inside = np.nonzero(folds == k)[0]
                model = fit_linear(sample, y, (folds != k).astype(float), earlier)
                out[inside] = model.probability([docs[i] for i in inside], earlier[inside])
            earlier = np.column_stack((earlier, out))
    return models


def hashed(text: Column) -> Column:
    @pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: words_of(t).tobytes(), na_action=None)

    return run(text.cast("binary"))


def train(docs: DataFrame, labels: DataFrame, categories: list[str], train_rows: int = TRAIN_ROWS) -> list[Linear]:
    """The chain's models from a bounded sample that is fitted on the driver.

    labels: doc_id and a 0/1 column of each category. Rows with nulls are left out; repeated ids count once, with the
    highest values. A category of one class gets a constant.
    """
    picked = labels.dropna(subset=["doc_id", *categories]).groupBy("doc_id").agg(*[F.max(c).cast("int").alias(f"_y{i}") for i, c in enumerate(categories)])
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.select(F.xxhash64("doc_id").alias("_h"), hashed(F.col("text")).alias("_words"), *[f"_y{i}" for i in range(len(categories))])
    # of copies of an id as many rows are fitted on as the bound allows
    table = rows.orderBy("_h", "_words").limit(train_rows).toPandas()
    words = [np.frombuffer(w, np.uint32) for w in table["_words"]]
    return fit_chain(words, table[[f"_y{i}" for i in range(len(categories))]].to_numpy(np.float64), table["_h"].to_numpy() % FOLDS)


def score(docs: DataFrame, models: list[Linear], categories: list[str]) -> DataFrame:
    """doc_id and a probability p_<category> of each row of docs, over whole texts.

    Null and empty texts have no words and get the offsets' probabilities; texts of any length are read whole; repeated
    rows are scored each; an empty table gives an empty result; other columns of docs are not read.
    """

    @pandas_udf(", ".join(f"p_{c} double" for c in categories))
    def run(texts: pd.Series) -> pd.DataFrame:
        words, found = [words_of(t) for t in texts], np.zeros((len(texts), 0))
        for model in models:
            found = np.column_stack((found, model.probability(words, found)))
        return pd.DataFrame(found, columns=[f"p_{c}" for c in categories])

    return docs.select("doc_id", run(F.col("text").cast("binary")).alias("p")).select("doc_id", "p.*")
