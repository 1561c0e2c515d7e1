"""The pipeline's near copies against brute-force Jaccard similarity of five-word shingles."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from fieldglass.llm import shingles, simhash
from tests.llm.test_near_copies import roots


def plain_set(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def expected_roots(texts):
    """Least index of each text's group."""
    sets, up = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, j in combinations(range(len(texts)), 2):
        if similar(sets[i], sets[j]):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.near_copies(spark, df, "")
    assert out.columns == df.columns
    return sorted(map(tuple, out.collect()), key=str)


def test_edited_copies_from_sixty_percent_up(spark):
    rng, texts = np.random.default_rng(11), []
    for n in [30, 60, 120, 400] * 6:
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5, 8):
            words = list(base)
            for at in rng.integers(0, n, max(1, edits * n // 250)):
                words[at] = f"e{rng.integers(0, 1 << 30)}"
            texts.append(" ".join(words))
    roots = expected_roots(texts)
    want = sorted(((i, t, "s") for i, t in enumerate(texts) if roots[i] == i), key=str)
    assert 24 < len(want) < len(texts) // 2
    assert kept(spark, [(i, t, "s") for i, t in enumerate(texts)]) == want


def test_documents_of_the_small_corpus(spark, medium):
    rows = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text", "source").orderBy("doc_id").collect()]
    roots = expected_roots([r[1] for r in rows])
    assert kept(spark, rows) == sorted((r for i, r in enumerate(rows) if roots[i] == i), key=str)


def test_rows_that_repeat_an_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, "s"), (2, a + " more", "s"), (2, b, "s"), (2, b, "t"), (3, None, "s"), (4, "", "s"), (None, a, "s")]
    assert kept(spark, rows) == sorted([(1, a, "s"), (2, b, "s"), (3, None, "s"), (None, a, "s")], key=str)


def test_pairs_of_a_crowded_signature(spark):
    """A chain: each is near the next only, and one signature holds them all."""
    words = [f"w{i}" for i in range(160)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 60, 5)]
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    names = list(range(len(texts)))
    crowd = spark.createDataFrame([(7, k) for k in names], "sig long, key long")
    packed = spark.createDataFrame([(k, s.tobytes()) for k, s in zip(names, sets)], "key long, set binary")
    got = {r["node"]: r["root"] for r in shingles._links(crowd, packed).collect()}
    assert len(set(got.values())) == 1 and len(got) == len(texts)


def test_a_crowded_signature_of_sets_near_the_limit(spark):
    """Edited copies of one text, most of them just under or over the limit: all links of brute force, far fewer pairs than all."""
    rng, base = np.random.default_rng(3), [f"w{i}" for i in range(100)]
    texts = []
    for n in range(90):
        words = list(base)
        for at in rng.integers(0, 100, n % 6):
            words[at] = f"e{n}-{at}"
        texts.append(" ".join(words[: 100 - n % 4]))
    texts = sorted(set(texts))
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    roots = expected_roots(texts)
    crowd = spark.createDataFrame([(7, k) for k in range(len(texts))], "sig long, key long")
    packed = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "key long, set binary")
    got = {r["node"]: r["root"] for r in shingles._links(crowd, packed).collect()}
    groups = lambda of: {frozenset(k for k in range(len(texts)) if of(k) == r) for r in map(of, range(len(texts)))}
    assert groups(lambda k: got.get(k, k)) == groups(roots.__getitem__)
    assert 1 < len(groups(roots.__getitem__)) < len(texts)
    near = {(i, j) for i, j in combinations(range(len(texts)), 2) if similar(plain_set(texts[i]), plain_set(texts[j]))}
    alone = spark.createDataFrame([(k, k) for k in range(len(texts))], "key long, root long")
    asked = {tuple(r) for r in shingles._candidates(alone, packed).collect()}
    assert near <= asked and len(asked) < len(texts) * (len(texts) - 1) // 2


@pytest.mark.parametrize("text", ["", "one", "one two three four five", "x " * 9000])
def test_shingle_sets(text):
    assert len(shingles.shingle_set(text.encode())) == len(plain_set(text))


def test_fingerprints_find_pairs_before_signatures(spark):
    """Without any signature in common the pairs come from SimHash: those within 4 bits that are similar enough, and no others."""
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(["first", *base]), " ".join(f"x{x}" for x in rng.integers(0, 5000, 400)), "a b c d e f", "a b c d e f a b c d e f"]
    rows = [(i, i, t.encode()) for i, t in enumerate(texts)]
    marked = shingles._mapped(spark.createDataFrame(rows, "id long, h long, t binary"), 5, shingles._signed, "key long, bands array<long>, fp long")
    keys = {r["key"]: r["id"] for r in marked.collect()}
    prints = {r["key"]: r["fp"] & (1 << 64) - 1 for r in marked.collect()}
    assert prints == {k: simhash.fingerprint(texts[i].encode(), 5) for k, i in keys.items()}
    near = shingles._near_prints(marked.select("key", "fp"))
    close = [(a, b) for a, b in combinations(keys, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert close and roots(keys, [tuple(r) for r in near.collect()]) == roots(keys, close)
    packed = spark.createDataFrame([(k, shingles.shingle_set(texts[i].encode()).tobytes()) for k, i in keys.items()], "key long, set binary")
    got = {keys[r["node"]]: keys[r["root"]] for r in shingles._links(spark.createDataFrame([], "sig long, key long"), packed, near).collect()}
    assert len(got) >= 2 and set(got) <= {0, 1, 2}
