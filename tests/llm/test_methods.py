"""The methods themselves against plain versions: the classifier chain, the walk of the trees, the hash tree, URLs of domains never seen."""

import base64
import json
import math
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fieldglass.llm import quality, secrets, sharding, shingles, simhash, toxicity as tx, trees, urls
from fieldglass.llm.common import table
from fieldglass.llm.queries import QUERIES


def made_documents(seed=3, n=240):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    texts, labels = [], []
    for _ in range(n):
        picked = rng.choice(vocabulary, rng.integers(4, 14))
        bad = int("w1" in picked or rng.random() < 0.1)
        labels.append((bad, int(("w2" in picked and bad) or rng.random() < 0.05)))
        texts.append(" ".join(picked).encode())
    return [tx.words_of(t) for t in texts], np.array(labels, float)


def plain_fit(docs, y, earlier, rounds=60_000):
    """The same objective on a dense matrix by small plain steps: a penalty picks words, a tenth of it weighs them."""
    every, counts = np.unique(np.concatenate(docs), return_counts=True)
    names = every[counts >= 3]
    x = np.array([np.isin(names, d) for d in docs], float)
    n, extra = len(docs), tx.log_odds(earlier)

    def descend(x, penalty):
        whole = np.hstack((x, extra, np.ones((n, 1))))
        step, z = 4 * n / (np.linalg.norm(whole, 2) ** 2), np.zeros(whole.shape[1])
        z[-1] = np.log(y.mean() / (1 - y.mean()))
        for _ in range(rounds):
            new = z - step * whole.T @ (1 / (1 + np.exp(-whole @ z)) - y) / n
            new[: x.shape[1]] = np.sign(new[: x.shape[1]]) * np.maximum(np.abs(new[: x.shape[1]]) - step * penalty, 0)
            if np.abs(new - z).max() < 1e-12:
                break
            z = new
        return z, whole

    z, _ = descend(x, tx.PENALTY / np.sqrt(n))
    keep = np.abs(z[: x.shape[1]]) > 1e-9
    z, whole = descend(x[:, keep], tx.PENALTY / 10 / np.sqrt(n))
    return 1 / (1 + np.exp(-whole @ z)), names[keep]


def test_a_link_of_the_chain_is_the_penalised_fit():
    docs, labels = made_documents()
    earlier = np.random.default_rng(1).uniform(0.05, 0.95, (len(docs), 1))
    for given in (np.zeros((len(docs), 0)), earlier):
        model = tx.fit_linear(tx.Sample.of(docs), labels[:, 0], np.ones(len(docs)), given, rounds=20_000)
        want, names = plain_fit(docs, labels[:, 0], given)
        assert set(model.words) == set(names) and np.abs(model.probability(docs, given) - want).max() < 3e-3


def test_later_links_learn_from_probabilities_of_other_folds():
    docs, labels = made_documents()
    folds, everyone = np.arange(len(docs)) % 3, np.ones(len(docs))
    models = tx.fit_chain(docs, labels, folds)
    out = np.zeros(len(docs))
    for k in range(3):  # fitted on the other folds' documents alone, as if these did not exist
        inside = [i for i in range(len(docs)) if folds[i] == k]
        rest = [i for i in range(len(docs)) if folds[i] != k]
        sample = tx.Sample.of(docs)
        model = tx.fit_linear(sample, labels[:, 0], np.isin(np.arange(len(docs)), rest).astype(float), np.zeros((len(docs), 0)))
        out[inside] = model.probability([docs[i] for i in inside], np.zeros((len(inside), 0)))
    second = tx.fit_linear(tx.Sample.of(docs), labels[:, 1], everyone, out[:, None])
    assert np.allclose(models[1].weights, second.weights) and np.allclose(models[1].chain, second.chain) and len(models[1].chain) == 1
    # the held fold's labels do not reach its own probabilities
    other = labels.copy()
    other[folds == 0, 0] = 1 - other[folds == 0, 0]
    again = tx.fit_linear(tx.Sample.of(docs), other[:, 0], (folds != 0).astype(float), np.zeros((len(docs), 0)))
    inside = [i for i in range(len(docs)) if folds[i] == 0]
    assert np.allclose(again.probability([docs[i] for i in inside], np.zeros((len(inside), 0))), out[inside])


def test_scores_are_the_chain_read_word_by_word(spark):
    docs, labels = made_documents()
    models = tx.fit_chain(docs, labels, np.arange(len(docs)) % 3)
    texts = [(1, "w1 W2, w3"), (2, "unseen"), (3, None), (4, "w1 w2 w5 w7 " * 500)]
    got = {r["doc_id"]: (r["p_a"], r["p_b"]) for r in tx.score(spark.createDataFrame(texts, "doc_id long, text string"), models, ["a", "b"]).collect()}
    for i, text in texts:
        words, p = set(tx.words_of(text.encode() if text else None).tolist()), []
        for m in models:
            raw = m.offset + sum(w for h, w in zip(m.words.tolist(), m.weights) if h in words)
            raw += sum(c * math.log(min(max(q, 1e-4), 1 - 1e-4) / (1 - min(max(q, 1e-4), 1 - 1e-4))) for c, q in zip(m.chain, p))
            p.append(1 / (1 + math.exp(-raw)))
        assert np.allclose(got[i], p, atol=1e-9)


def walk(forest, x):
    """Node by node, tree by tree."""
    total = forest.base
    for root in forest.roots:
        at = root
        while forest.feature[at] >= 0:
            at = forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        total += forest.value[at]
    return 1 / (1 + math.exp(-total))


def test_quality_verdicts_are_a_plain_walk_of_the_trees(spark, medium):
    docs, labels = table(spark, medium, "documents").select("doc_id", "text"), table(spark, medium, "labels")
    forest = quality.train(docs, labels)
    assert len(forest.roots) > 20 and (forest.feature >= 0).any()
    names = [c.split()[0] for c in quality.STATISTICS.split(", ")]
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_rules"](spark, medium).collect()}
    for r in docs.collect():
        stats = dict(zip(names, quality.statistics(r["text"].encode() if r["text"] is not None else None)))
        score = walk(forest, [stats[f] for f in quality.FEATURES])
        failed = stats["n_words"] < 20 or 100 * stats["n_repeat_words"] > 30 * stats["n_words"]
        own = got[r["doc_id"]]
        assert abs(own["score"] - score) < 2e-6 and own["base_failed"] == failed
        if abs(score - 0.5) > 1e-9:
            assert own["kept"] == (not failed and score >= 0.5)


def test_forest_of_one_leaf():
    x = np.zeros((30, 2))
    forest = trees.fit(x, np.array([0.0, 1.0] * 15), [0, 0], trees=3)
    assert all(abs(walk(forest, row) - p) < 1e-12 for row, p in zip(x, forest.probability(x)))


def hashed(key, *more):
    """xxhash64 of a long, then of whole numbers: each hash is the next one's seed."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    for v in more:
        h = xxhash.xxh64_intdigest(struct.pack("<i", v), h)
    return h


def plain_shard(key, root):
    """From the root down: the least -ln(u) / weight among the children."""

    def draw(weights, *path):
        return min(range(len(weights)), key=lambda i: (-math.log(((hashed(key, len(path), *path, i) >> 11) + 0.5) * 2.0**-53) / weights[i], i))

    region = draw([sum(w for rack in r for _, w in rack) for r in root])
    rack = draw([sum(w for _, w in rack) for rack in root[region]], region)
    child = draw([w for _, w in root[region][rack]], region, rack)
    return root[region][rack][child][0]


def test_shards_are_weighted_draws_down_the_tree(spark, small):
    now, grown = sharding.tree(24, sharding.LAYOUT), sharding.tree(25, sharding.LAYOUT)
    for r in QUERIES["op6_shards"](spark, small).collect():
        assert (r["shard"], r["grown_shard"]) == (plain_shard(r["doc_id"], now), plain_shard(r["doc_id"], grown))


def test_rows_without_id_are_one_shard_in_many_parts(spark):
    rows = sharding.shard(spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text")), 24).collect()
    assert len({r["shard"] for r in rows}) == 1 and sorted(r["slot"] for r in rows) == list(range(4000))


def test_urls_of_domains_never_seen(spark, medium):
    """Whole domains are held out, so no page of theirs is among the labels."""
    pages = table(spark, medium, "pages").select("page_id", "url").where("url is not null")
    domain = F.substring_index(urls.host_of(F.col("url")), ".", -2)
    held = F.pmod(F.crc32(domain.cast("binary")), F.lit(4)) == 0
    labels = urls.weak_labels(pages)
    got = urls.judge(pages.where(held), labels.where(~held), rules=()).join(pages.join(labels, "url").select("page_id", "label").distinct(), "page_id").collect()
    right = sum((r["verdict"] == "block") == (r["label"] == 1) for r in got)
    print("unseen domains:", len(got), "pages,", right, "right,", sum(r["label"] for r in got), "to block,", sum(r["label"] == 1 and r["verdict"] == "block" for r in got), "blocked of those")
    assert got and right / len(got) >= 0.5


def test_near_copies_keep_columns_of_any_name_and_type(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, 7, 8, "r", {"b": 1, "a": 2}), (1, words, 7, 8, "r", {"b": 1, "a": 2}), (2, words, 1, 2, "s", None), (3, "other text of its own", 1, 2, "s", {}), (None, words, 0, 0, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _h int, row string, more map<string,int>")
    for dedup in (shingles.dedup, simhash.dedup):
        got = dedup(docs)
        assert got.columns == docs.columns and sorted((r["doc_id"] or 0, r["_id"], r["more"] and dict(r["more"])) for r in got.collect()) == [(0, 0, None), (1, 7, {"b": 1, "a": 2}), (3, 1, {})]


def test_pairs_of_crowded_shingles_meet_in_blocks(spark, monkeypatch):
    """Sets near the limit that share a frequent shingle: dealt into blocks of two, the groups stay those of all pairs."""
    rng = np.random.default_rng(4)
    base = [f"a{i}" for i in range(60)]
    docs = [(k, " ".join(base[: 60 - k % 7] + [f"t{k}x{j}" for j in range(k % 5)]) if k % 3 else " ".join(rng.choice(base, 50))) for k in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(r["doc_id"] for r in shingles.dedup(frame).collect())
    monkeypatch.setattr(shingles, "HOLDERS", 2)
    assert sorted(r["doc_id"] for r in shingles.dedup(frame).collect()) == whole and len(whole) < 60


def test_long_headers_of_tokens_are_read():
    head = base64.urlsafe_b64encode(json.dumps({"alg": "RS256", "x5c": ["A" * 20_000]}).encode()).decode().rstrip("=")
    text = f"key {head}.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJlMTIz end"
    assert [(k, text[a:b].count(".")) for a, b, k in secrets.spans(text) if k == "jwt"] == [("jwt", 2)]
