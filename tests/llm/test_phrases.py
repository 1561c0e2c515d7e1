"""Phrases: the relations' passes against plain counting."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import phrases as ph
from fieldglass.llm.queries import ORACLES, QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, longest=3, least=10, share=50, count=2000):
    f, n, out = Counter(), Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    for lang in {k[0] for k in candidates}:
        rows = []
        for (own, p), a in candidates.items():
            if own != lang:
                continue
            if any(o == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in candidates.items()):
                continue
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:count])]
    return sorted(out)


def made(seed, n=400):
    rng = random.Random(seed)
    words = [*"abcdefgh", "Ä", "ä", "É", "n\xa0o", "it's", "x\x1cy"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "?!"]) for _ in range(rng.randrange(30)))
    return [(rng.choice(["en", "fr", None]), text().upper() if rng.random() < 0.2 else text()) for _ in range(n)] + [("en", None), ("de", ""), ("und", "a b a b a b")]


def mined(spark, docs, **how):
    rows = ph.mine(spark.createDataFrame(docs, "lang string, text string").repartition(3), **how)
    return sorted(tuple(r) for r in rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("how", [{}, {"longest": 4, "least": 3}, {"longest": 2, "least": 5}, {"count": 7, "least": 4, "share": 90}, {"longest": 5, "least": 2, "share": 10}])
def test_mine_equals_plain_counting(spark, how):
    docs = made(len(how))
    got = mined(spark, docs, **how)
    assert got == plain(docs, **how) and got


def test_overlaps_ties_and_repeats(spark):
    docs = [("en", "x x x x x x x x x x x x")] + [("en", "p q r")] * 12 + [("fr", "p q r")] * 9
    assert mined(spark, docs) == plain(docs)


def test_portions_cut_nothing_off(spark, monkeypatch):
    docs = made(8) + [("en", "a b c " * 5000)]
    whole = mined(spark, docs)
    monkeypatch.setattr(ph, "STEP", 64)
    monkeypatch.setattr(ph, "TEXT", 100)
    assert mined(spark, docs) == whole == plain(docs)


def test_a_small_filter_lets_more_through_and_changes_nothing(spark, monkeypatch):
    docs = made(5)
    whole = mined(spark, docs)
    monkeypatch.setattr(ph, "MOST_BITS", 64)
    monkeypatch.setattr(ph, "BITS", 1)
    assert mined(spark, docs) == whole


def test_words_whose_numbers_clash_are_numbered_anew(spark, monkeypatch):
    words = spark.createDataFrame([("en", b"aa", 20), ("fr", b"bb", 20), ("fr", b"aa", 1)], "lang string, word binary, f long")
    real = F.xxhash64

    def weak(c):
        return F.when(F.startswith(F.hex(c), F.lit("")) & (F.length(c) == 2), F.lit(7)).otherwise(real(c))

    monkeypatch.setattr(ph.F, "xxhash64", weak)
    rows, salt = ph.numbered(words)
    monkeypatch.undo()
    assert salt != b"" and {(r["word"], r["g"][0]) for r in rows.collect()} == {(w, ph.number(w, salt)) for w in (b"aa", b"bb")}


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**9
    one = spark.createDataFrame([("en", [1], big), ("en", [2], big + 1)], "lang string, g array<long>, f long")
    two = spark.createDataFrame([("en", [1, 2], big - 7)], "lang string, g array<long>, f long")
    assert ph.scored({1: one, 2: two}).first()["score"] == 10**6 * (big - 7) ** 2 // (big * (big + 1))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert ph.mine(empty).collect() == [] and mined(spark, [("en", "a b")]) == []
    clash = spark.createDataFrame([("en", "a b", 1, 2)] * 12, "lang string, text string, rank int, g int")
    assert [r["phrase"] for r in ph.mine(clash).collect()] == ["a b"]
    assert np.array_equal(ph._extended(np.arange(3), np.array([False, True, False]), np.ones(3, bool), 2), [0])


def test_query_matches_sql(spark, medium):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{medium}/documents.parquet'")
    cols = "lang, rank, phrase, a, l, r, n, score"
    rows = QUERIES["op13_phrases"](spark, medium).select(*cols.split(", ")).collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"select {cols} from ({ORACLES['op13_phrases']})").fetchall())


def test_filter_reaches_the_driver_in_whole_pieces(spark, monkeypatch):
    """A few bytes for each piece of the map, not a row for each slot; every group passes, few others do."""
    from pyspark.sql.classic.dataframe import DataFrame

    monkeypatch.setattr(ph, "PIECE", 1 << 8)
    came, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "toPandas", lambda df: pytest.fail("slots sent one by one"))
    monkeypatch.setattr(DataFrame, "collect", lambda df: came.extend(rows := collect(df)) or rows)
    rng = np.random.default_rng(2)
    groups = rng.integers(-(1 << 62), 1 << 62, (3000, 2))
    frequent = spark.createDataFrame([("en", g) for g in groups.tolist()], "lang string, g array<bigint>")
    made = ph.Filter(frequent)
    assert len(came) == made.bits >> 8 and all(len(r["map"]) == 32 for r in came)
    assert made.passes()(groups).all() and made.passes()(rng.integers(-(1 << 62), 1 << 62, (3000, 2))).mean() < 0.05
