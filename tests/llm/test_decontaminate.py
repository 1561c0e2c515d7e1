"""Benchmark windows: the shift-table search against a plain one, in one pass and in many."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import decontaminate as dc
from fieldglass.llm.queries import ORACLES, QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain(text, items, size):
    """Hit words and item ids by trying every window at every place."""
    w, hit, met = plain_words(text), set(), set()
    for item, body in items:
        b = plain_words(body)
        n = min(size, len(b))
        for i in range(len(b) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at : at + n] == b[i : i + n]:
                    hit |= set(range(at, at + n))
                    met.add("" if item is None else str(item))
    return len(w), len(hit), sorted(met)


def made(seed, n_docs=40, n_items=12):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Été", "x1", "MIX", "ß", "a", "Zwölf"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i // 2 if i % 5 else None, text(rng.choice([0, 1, 2, 3, 4, 7, 9, 30]))) for i in range(n_items)]
    docs = [(i // 2, text(rng.choice([0, 2, 5, 20, 80]))) for i in range(n_docs)]
    docs += [(90 + i, text(6) + " ; " + body.upper().replace("SS", "ß") + " ; " + text(5)) for i, (_, body) in enumerate(items)]
    return docs + [(200, None), (None, "the of"), (201, ""), (201, "")], items + [(77, None), (78, "--")]


@pytest.mark.parametrize("size, held", [(10, 100_000), (4, 100_000), (4, 6), (3, 3)])
def test_scan_equals_every_window_at_every_place(spark, size, held):
    docs, items = made(size + held)
    got = dc.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), size, held=held)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None)
    rows = sorted(((r["doc"]["doc_id"], r["doc"]["text"], r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect()), key=key)
    want = sorted(((i, t, *plain(t, items, size)) for i, t in docs), key=key)
    assert rows == want and any(r[3] for r in rows)


def test_long_items_lose_no_window_where_they_are_cut(spark, monkeypatch):
    monkeypatch.setattr(dc, "PIECE", 7)
    body = " ".join(f"w{i}" for i in range(60))
    rows = dc.pieces(spark.createDataFrame([(1, body)], "item_id int, text string"), 10, "item_id", "text").collect()
    windows = {tuple(r["words"][i : i + 10]) for r in rows for i in range(len(r["words"]) - 9)}
    assert len(rows) > 1 and len(windows) == 51


def test_shift_tables_skip_only_where_nothing_ends():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(60))]
        items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(12))]) for i in range(4)]
        runs, met = dc.search(words, dc.patterns(items, 5))
        hit, ids = set(), set()
        for item, text in items:
            n = min(5, len(text))
            for i in range(len(text) - n + 1 if n else 0):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == text[i : i + n]:
                        hit |= set(range(at, at + n))
                        ids.add(item)
        assert {p for a, b in runs for p in range(a, b)} == hit and met == sorted(ids)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "one two three", "a", 5), (1, "one two three", "b", 5), (2, None, None, None)], "doc_id long, text string, doc string, n_hit int")
    items = spark.createDataFrame([(1, "Two, THREE", 9)], "item_id long, text string, runs int")
    rows = dc.scan(docs, items)
    assert sorted((r["doc"]["doc"] or "", r["n_hit"], r["doc"]["n_hit"]) for r in rows.collect()) == [("", 0, None), ("a", 2, 5), ("b", 2, 5)]
    assert dc.scan(docs.limit(0), items).collect() == [] and {r["n_hit"] for r in dc.scan(docs, items.limit(0)).collect()} == {0}
    kept = dc.decontaminate(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
    spans = rows.select(F.col("doc.text").alias("t"), dc.spans(F.col("doc.text"), F.col("runs")).alias("s")).where("t is not null").first()
    assert [spans["t"][x["start"] : x["end"]] for x in spans["s"]] == ["two three"]
    long = spark.createDataFrame([(1, "filler " * 300_000 + "two three")], "doc_id long, text string")
    assert dc.scan(long, items).first()["n_hit"] == 2


def test_query_matches_sql(spark, small):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    cols = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    rows = QUERIES["op11_decontaminate"](spark, small).select(*cols.split(", ")).collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"select {cols} from ({ORACLES['op11_decontaminate']})").fetchall())
    none = hashlib.sha256(b"").hexdigest()
    assert all((r["items_sha256"] == none) == (r["n_items"] == 0) for r in rows) and any(r["contaminated"] for r in rows)
