"""SimHash and embedding near-duplicates against brute force."""

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldglass.llm import embeddings, simhash
from fieldglass.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, n=4):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected_groups(docs):
    fps = {i: plain_fingerprint(t) for i, t in docs}
    found = roots(fps, [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    return sorted((i, f"{fps[i]:016x}", found[i]) for i in fps)


def test_simhash_query_is_brute_force(spark, small):
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op3_simhash_near_dedup"](spark, small).collect())) == expected_groups(docs)


def test_simhash_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two İstanbul K"), (7, base), (8, base + " more"), (9, "x " * 70_000), (10, "x x x x")]
    df = spark.createDataFrame([(*d, "s", "clash") for d in docs], "doc_id long, text string, source string, fp string")
    assert sorted(map(tuple, simhash.groups(df).collect())) == expected_groups(docs)
    assert simhash.groups(df.where("doc_id < 0")).collect() == []
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(None, base, "s", "c")], df.schema))
    got = sorted((r["doc_id"] for r in simhash.dedup(twice).collect()), key=str)
    assert got.count(None) == 1 and got.count(1) == 1 and 2 not in got and 5 not in got


def test_dedup_tells_rows_of_one_id_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    rows = [(1, a, "s"), (1, b, "s"), (2, a, "s"), (3, b, "t"), (3, b, "s"), (4, None, "s"), (5, "", "s"), (5, " ", "s")]
    got = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, a, "s"), (1, b, "s"), (4, None, "s")], key=str)
    assert simhash.dedup(got.limit(0)).collect() == []


def test_crowded_groups_are_looked_up(spark, monkeypatch):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(list("abcdefgh"), 12))) for i in range(60)] + [(100 + i, "one text for many") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, simhash.groups(df).collect()))
    monkeypatch.setattr(simhash, "CROWDED", 3)
    assert sorted(map(tuple, simhash.groups(df).collect())) == want == expected_groups(docs)


@pytest.mark.parametrize("heavy", [4096, 3])
def test_links_lose_nothing(spark, heavy):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2)
    fps = set()
    for c in centres:
        for _ in range(25):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    got = [tuple(r) for r in simhash.links(df, 4, heavy).select("a", "b").collect()]
    near = [(signed[a], signed[b]) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4]
    if heavy == 4096:
        assert sorted(tuple(sorted(p)) for p in got) == sorted(tuple(sorted(p)) for p in near)
    assert roots(signed.values(), got) == roots(signed.values(), near)


def plain_links(rows):
    good = {}
    for i, e, label in rows:
        v = None if e is None or any(x is None for x in e) else np.array(e, np.float32).astype(np.float64)
        if v is not None and label is not None and np.isfinite(v).all() and v.any():
            good[i] = (v, label)
    links = []
    for (i, (v, a)), (j, (w, b)) in combinations(good.items(), 2):
        if a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
            links.append((i, j))
    ids = [r[0] for r in rows]
    found, n = roots(ids, links), dict.fromkeys(ids, 0)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    return sorted((i, n[i], found[i], found[i] == i) for i in ids)


def test_embedding_query_is_brute_force(spark, medium):
    rows = [tuple(r) for r in spark.read.parquet(f"{medium}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, QUERIES["op2_embedding_near_dedup"](spark, medium).collect())) == plain_links(rows)


def test_several_blocks_in_a_cell(spark, monkeypatch):
    """Blocks of eight rows: every pair of blocks of a cell meets once."""
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng, rows = np.random.default_rng(9), []
    for centre in rng.normal(size=(4, 6)):
        rows += [(len(rows) + k, (centre + 0.3 * rng.normal(size=6)).astype(np.float32).tolist(), int(rng.integers(2))) for k in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == plain_links(rows)


def test_embedding_dense_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows, base = [], rng.normal(size=8)
    for spread in (0.02, 0.1, 0.25):  # a dense core, a ring at the threshold, a loose cloud
        rows += [(len(rows) + k, (base + spread * rng.normal(size=8)).astype(np.float32).tolist(), int(rng.integers(2))) for k in range(150)]
    rows += [(900 + k, rows[k][1], rows[k][2]) for k in range(40)]  # exact copies
    odd = [None, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [], [1.0, 2.0], [2.0, 4.0]]
    rows += [(2000 + k, e, 1) for k, e in enumerate(odd)] + [(3000, rows[0][1], None)]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": [r[0] for r in rows]}), "vec_id long").join(spark.createDataFrame([(r[0], r[1], r[2], "x") for r in rows], "vec_id long, embedding array<float>, label int, n string"), "vec_id")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == plain_links(rows)
    assert embeddings.near_duplicates(df.where("vec_id < 0")).collect() == []
    assert embeddings.near_duplicates(df.where("vec_id = 2000")).collect() == [(2000, 0, 2000, True)]


@pytest.mark.parametrize("cell, block", [(30, 8), (30, 500), (1000, 500)])
def test_visitors_of_cells_meet_their_own_rows(spark, monkeypatch, cell, block):
    """Several cells of a label, with a dense core, rings and rows between them, in one block or in many."""
    monkeypatch.setattr(embeddings, "CELL", cell)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng, rows = np.random.default_rng(11), []
    for centre, spread in [(c, s) for c in rng.normal(size=(3, 5)) for s in (0.02, 0.2, 0.5)]:
        rows += [(len(rows) + k, (centre + spread * rng.normal(size=5)).astype(np.float32).tolist(), int(rng.integers(2))) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == plain_links(rows)


def test_vectors_are_sent_once_while_a_label_fits_in_a_block(spark, monkeypatch):
    """Vectors in all directions, which no cell leaves out: what is sent for comparison does not grow faster than the table."""
    sent, blocks = [], embeddings._blocks

    def counted(*args):
        sides = blocks(*args)
        sent.append(sum(side.count() for side in sides))
        return sides

    monkeypatch.setattr(embeddings, "_blocks", counted)
    x = np.random.default_rng(3).normal(size=(12_000, 4)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist(), "label": np.arange(len(x)) % 4}), "vec_id long, embedding array<float>, label int")
    for n in (3000, 12_000):
        assert embeddings.near_duplicates(df.where(F.col("vec_id") < n)).count() == n
    assert sent[0] <= 1.1 * 3000 and sent[1] <= 1.1 * 12_000


def test_chain_whose_middle_link_is_neither_ends_least(spark):
    """1-10, 5-10, 2-5: the link of 5 and 10 is the least of neither, and joins all four."""
    angles = {1: 0, 10: 20, 5: 40, 2: 60}
    rows = [(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))], 1) for i, a in angles.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == plain_links(rows) == [(1, 1, 1, True), (2, 1, 1, False), (5, 2, 1, False), (10, 2, 1, False)]
