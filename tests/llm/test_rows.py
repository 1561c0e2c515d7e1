"""Mixing, URL filters, sharding and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldglass.llm import mixing, quality, sharding, urls
from fieldglass.llm.common import running_sum, table
from fieldglass.llm.queries import ORACLES, QUERIES
from tests.llm.test_shingles import expected_roots

ODD = [(1, None, None), (2, "", "b"), (3, "one two", None), (4, "a b c " * 30_000, "a"), (4, "a b c " * 30_000, "a"), (None, "x y", "c"), (5, "w", ""), (6, "q r s", "z")]


def odd(spark):
    return spark.createDataFrame([(*r, 7) for r in ODD], "doc_id long, text string, source string, size long")


def plain_targets(sizes, weights=(1, 2, 3), repeats=3):
    """Water-filling by rounds: who would pass the cap stops there and the rest is shared anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, got = float(sum(sizes.values())), set(names), {}
    while open_:
        share = left / sum(w[s] for s in open_)
        over = [s for s in open_ if share * w[s] > repeats * sizes[s]]
        if not over:
            return got | {s: share * w[s] for s in open_}
        for s in over:
            got[s] = repeats * sizes[s]
            left -= got[s]
            open_.remove(s)
    return got


def test_targets_by_rounds(spark, medium):
    rows = QUERIES["op4_mix_sources"](spark, medium).collect()
    docs = {r["doc_id"]: r["source"] for r in table(spark, medium, "documents").collect()}
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[docs[r["doc_id"]]] += r["size"]
        taken[docs[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    targets = plain_targets(dict(sizes))
    for r in rows:
        s = docs[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s], abs=1e-6)
        assert abs(taken[s] - targets[s]) <= 1


def test_mixing_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    found = con.execute(f"select doc_id, size, source_size, round(target, 6), taken, position from ({ORACLES['op4_mix_sources']})").fetchall()
    rows = QUERIES["op4_mix_sources"](spark, small).select("doc_id", "size", "source_size", F.round("target", 6), "taken", "position").collect()
    assert sorted(found) == sorted(map(tuple, rows))


def test_mixing_odd_rows(spark):
    rows = mixing.allot(odd(spark)).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken").collect()
    assert len(rows) == len(ODD)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    targets = plain_targets(dict(sizes))
    assert all(r["target"] == pytest.approx(targets[r["source"]]) for r in rows)
    assert mixing.allot(odd(spark).limit(0)).collect() == []
    assert mixing.mix(odd(spark)).columns == odd(spark).columns
    assert mixing.allot(odd(spark).where("size < 0 or text = ''")).select("taken").first()[0] == 0


@pytest.mark.parametrize("lean", [-0.5, 0.0, 0.5])
def test_curriculum(spark, lean):
    """moment() inverts the integral of the weight 1 + lean (2 t - 1)."""
    rows = spark.range(101).select((F.col("id") / 100).alias("d")).select("d", mixing.moment(F.col("d"), F.lit(lean)).alias("t")).collect()
    assert all(r["t"] + lean * (r["t"] ** 2 - r["t"]) == pytest.approx(r["d"], abs=1e-12) for r in rows)


def test_equal_spans_of_position_hold_equal_words_and_the_scheduled_shares(spark):
    """Thousands of one-word documents of three sources: words a tenth of the run, and each source's share of them."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    rows = mixing.mix(docs).select("source").collect()
    leans, goal = dict(zip("abc", mixing.LEANS)), plain_targets({s: 3000 for s in "abc"})
    tilt = sum(goal[s] * leans[s] for s in goal) / 9000
    assert len(rows) == 9000
    for tenth in range(10):
        part = Counter(r["source"] for r in rows[tenth * len(rows) // 10 : (tenth + 1) * len(rows) // 10])
        p = (tenth + 0.5) / 10
        t = p if abs(tilt) < 1e-12 else (tilt - 1 + math.sqrt((1 - tilt) ** 2 + 4 * tilt * p)) / (2 * tilt)
        weight = {s: goal[s] * (1 + leans[s] * (2 * t - 1)) for s in goal}
        for s in goal:
            assert part[s] / sum(part.values()) == pytest.approx(weight[s] / sum(weight.values()), abs=0.03)


def test_order_follows_the_curriculum(spark, medium):
    docs = table(spark, medium, "documents")
    rows = mixing.mix(docs, weights=(1,), leans=(-0.9, 0.9)).select("source").rdd.map(lambda r: r[0]).collect()
    names = {s: i for i, s in enumerate(sorted(set(rows)))}
    first, second = ([names[s] % 2 for s in half] for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]))
    assert np.mean(first) < np.mean(second)


def test_running_sum(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.md5(F.col("id").cast("string").cast("binary")).alias("d"), "id", (F.col("id") % 7).alias("v"))
    seen = defaultdict(int)
    got = {r["id"]: r["s"] for r in running_sum(df, ["k"], "d", ["id"], "v", "s").collect()}
    for r in sorted(df.collect(), key=lambda r: (r["k"], r["d"], r["id"])):
        assert got[r["id"]] == seen[r["k"]]
        seen[r["k"]] += r["v"]


# --- URLs


def plain_url(url, rules=urls.RULES):
    rest = (url or "").partition("://")[2]
    at = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    cut = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    path = path[:cut]
    best = None
    for verdict, rule in rules:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or (len(rule), rule) > (len(best[0]), best[0])):
            best = rule, verdict
    return host, path, best


def test_ten_thousand_rules_are_brute_force(spark):
    rng = np.random.default_rng(8)
    word = lambda n, of="abc": "".join(rng.choice(list(of), n))
    rules = {f"{'.'.join(word(rng.integers(1, 3)) for _ in range(rng.integers(1, 3)))}/{word(rng.integers(0, 7), 'ab/')}": "block" if rng.random() < 0.5 else "allow" for _ in range(60_000)}
    rules = [(v, r) for r, v in list(rules.items())[:10_000]]
    assert len(rules) == 10_000
    pages = [(i, f"http://{'.'.join(word(rng.integers(1, 3)) for _ in range(rng.integers(1, 5)))}/{word(rng.integers(0, 12), 'ab/')}?q") for i in range(300)] + [(300, None), (301, "x"), (302, "http://"), (303, "http://a..b/"), (304, "http://a..b/")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    sites = df.select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    rows = urls.ruled(sites, rules).collect()
    assert len(rows) == len(pages)
    texts, met = dict(pages), 0
    for r in rows:
        *_, best = plain_url(texts[r["page_id"]], rules)
        assert (r["rule"], r["ruled"]) == (best or (None, None))
        met += best is not None
    assert met > 100
    few = rules[:150]
    both = [sorted(map(tuple, f(sites, few).collect()), key=str) for f in (urls._in_plan, urls._joined)]
    assert both[0] == both[1]


def check_urls(rows, pages):
    assert len(rows) == len(pages)
    for r in rows:
        host, path, best = plain_url(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")


def test_url_query(spark, medium):
    pages = {r["page_id"]: r["url"] for r in table(spark, medium, "pages").collect()}
    check_urls(QUERIES["op5_url_filter"](spark, medium).collect(), pages)


def test_url_odd_rows(spark):
    found = [None, "", "://", "no scheme", "http://COM/x", "https://a.Example.com/en/x?y#z", "https://www.example.com/en/", "http://x.net/fr/?q", "http://net/es/a", "http://notnet/es/a", "http://a#b://c", "x" * 50_000, "http://h?x/y", "http://net/es"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(found)], "page_id long, url string, score int")
    labelled = spark.createDataFrame([("http://spam1.x/a", 1), ("http://fine.y/a", 0), (None, None)] * 20, "url string, label int")
    for labels in (labelled, labelled.limit(0), labelled.where("label = 1")):
        check_urls(urls.judge(pages, labels).collect(), dict(enumerate(found)))
    assert urls.judge(pages.limit(0), labelled).collect() == []


def test_url_trees_learn(spark):
    """Hosts with digits are blocked: held-out pages follow."""
    rng = np.random.default_rng(2)
    word = lambda n, of: "".join(rng.choice(list(of), n))
    rows = [(i, f"http://{word(8, 'abcdefgh0123456789' if i % 2 else 'abcdefgh')}.org/{word(5, 'xyz')}", i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = urls.judge(df.where("page_id >= 400"), df.where("page_id < 400").select("url", "label")).join(df, "page_id")
    assert got.where((F.col("verdict") == "block") == (F.col("label") == 1)).count() > 180


# --- shards


def check_shards(rows, texts):
    slots, moved = defaultdict(list), 0
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 24 and (r["grown_shard"] == r["shard"] or r["grown_shard"] == 24)
        moved += r["grown_shard"] == 24
        if texts is not None:
            data = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 8, zlib.crc32(data), "key")
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return slots, moved


def test_shards(spark, medium):
    texts = {r["doc_id"]: r["text"] for r in table(spark, medium, "documents").collect()}
    rows = QUERIES["op6_shards"](spark, medium).collect()
    assert len(rows) == len(texts)
    slots, moved = check_shards(rows, texts)
    assert len(slots) == 24 and 0 < moved


def test_shard_odd_rows(spark):
    rows = sharding.shard(odd(spark)).select("doc.doc_id", "shard", "slot", "grown_shard").collect()
    assert len(rows) == len(ODD)
    check_shards(rows, None)
    by_id = defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_id.values())
    assert sharding.shard(odd(spark).limit(0)).collect() == []


def test_weight_changes_stay_in_their_subtree(spark):
    ids = spark.range(3000)
    a = sharding.tree(24)
    b = sharding.tree(24)
    b[0][1][2] = (b[0][1][2][0], 3.0)  # one shard of region 0 grows
    both = sharding.descend(sharding.descend(ids, "id", a, "old"), "id", b, "new").collect()
    grown = b[0][1][2][0]
    assert any(r["old"] != r["new"] for r in both)
    assert all(r["old"] == r["new"] or r["new"] // 12 == 0 for r in both)
    assert all(r["new"] == grown for r in both if r["old"] != r["new"] and r["old"] // 4 == grown // 4)


# --- the pipeline


@pytest.fixture(scope="module")
def stages(spark, medium):
    """What each stage gets and gives."""
    docs, found = table(spark, medium, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, medium).cache()
        found.append((docs, out))
        docs = out
    return found


def test_pipeline_stages(spark, medium, stages):
    names = table(spark, medium, "documents").columns
    assert all(out.columns == names for _, out in stages[:-1])
    (docs, judged), (_, single), (_, clean), (_, mixed), (_, tokens) = stages
    verdict = quality.judge(docs, table(spark, medium, "labels")).where("kept").select("doc.doc_id")
    assert sorted(judged.select("doc_id").collect()) == sorted(verdict.collect())
    rows = sorted((r["doc_id"], r["text"]) for r in judged.collect())
    groups = expected_roots([text for _, text in rows])
    assert sorted(r[0] for r in single.select("doc_id").collect()) == [i for k, (i, _) in enumerate(rows) if groups[k] == k]
    assert clean.count() == single.count()
    before, after = Counter(), Counter()
    for r in clean.collect():
        before[r["source"]] += len(r["text"].encode().split())
    for r in mixed.collect():
        after[r["source"]] += len(r["text"].encode().split())
    longest = max(len(r["text"].encode().split()) for r in clean.collect())
    assert all(abs(after[s] - t) <= longest for s, t in plain_targets(dict(before)).items())
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert tokens.count() == mixed.count()
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids for r in tokens.collect())


def test_pipeline_runs_and_takes_odd_rows(spark, medium, stages):
    assert corpus_pipeline.run(spark, medium).count() == stages[-1][1].count()
    df = odd(spark).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    for rows in (df, df.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, medium)
        docs.collect()
