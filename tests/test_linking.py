"""Names in texts against reading every text for every name; keys that ignore case and accents."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldglass.functions.folding import COLLATION, folded, letters
from fieldglass.operators import linking as lk


@pytest.mark.parametrize("a, b", [("Łukasz", "lukasz"), ("Ødegaard", "odegaard"), ("Işık", "ISIK"), ("İlkay", "ilkay"), ("Müller", "müller"), ("Đorđe", "dorde"), ("straße", "STRASSE"), (" São ", "sao"), ("Çağlar Söyüncü", "caglar soyuncu")])
def test_keys(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(lk.key(F.col("a")) == lk.key(F.col("b")), lk.key(F.col("a")) == lk.key(F.lit(b + "x"))).first()
    assert tuple(row) == (True, False)


def plain_key(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def plain_mentions(text, names):
    words = [plain_key(w) for w in re.findall(r"\w+", text or "")]
    known = {}
    for name, kind, entity in names:
        known.setdefault(tuple(plain_key(w) for w in re.findall(r"\w+", name)), set()).add((kind, str(entity)))
    out, at = [], 0
    while at < len(words):
        for n in range(max(map(len, known)), 0, -1):
            here = known.get(tuple(words[at : at + n])) if at + n <= len(words) else None
            if here:
                out.append((at, n, *min(here), len(here) > 1))
                at += n - 1
                break
        at += 1
    return out


WORDS = ["Da", "Silva", "José", "jose", "van", "Dijk", "United", "é", "Ćić", "FC"]


def made(seed):
    rng = random.Random(seed)
    name = lambda most: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, most)))
    clubs = [(name(2), "club", f"c{i}") for i in range(4)]
    players = [(name(3), "player", str(i)) for i in range(12)]
    club_of = {str(i): f"c{rng.randrange(4)}" for i in range(12)}
    texts = [(i, rng.choice([" ", ", ", "-"]).join(rng.choice([*WORDS, "x", "SILVA", "the"]) for _ in range(rng.randrange(25)))) for i in range(60)] + [(60, None), (61, "")]
    return clubs + players, club_of, texts


@pytest.mark.parametrize("seed", [0, 2, 3])
def test_mentions_and_links_are_those_of_reading_each_text(spark, seed):
    names, club_of, texts = made(seed)
    t = spark.createDataFrame(texts, "id long, text string").repartition(3)
    found = lk.mentions(t, spark.createDataFrame([*names, (None, "player", "99")], "name string, kind string, entity string"), "id", "text")
    rows = sorted(tuple(r) for r in found.collect())
    want = sorted((i, *m) for i, text in texts for m in plain_mentions(text, names))
    assert rows == want and any(r[2] > 1 for r in rows)
    links = lk.linked(found, spark.createDataFrame(list(club_of.items()), "entity string, club string"), "id")
    expected = set()
    for i, text in texts:
        said = {(kind, e) for _, _, kind, e, unsure in plain_mentions(text, names) if not unsure}
        expected |= {(i, e, club_of[e]) for kind, e in said if kind == "player" and ("club", club_of[e]) in said}
    assert sorted(map(tuple, links.collect())) == sorted(expected) and expected
    levels = {r["id"]: r["level"] for r in lk.standing(t, found, links, "id").collect()}
    assert len(levels) == len(texts) and all((levels[i] == "player") == any(e[0] == i for e in expected) for i, _ in texts)


def test_conflicts(spark):
    texts = spark.createDataFrame([(1, "A knock for him"), (2, "He plays"), (3, None)], "id long, text string")
    links = spark.createDataFrame([(1, "a", "c"), (2, "a", "c"), (1, "b", "c"), (2, "b", "c"), (3, "b", "c"), (2, "m", "c")], "id long, entity string, club string")
    minutes = spark.createDataFrame([("a", 90.0), ("b", 10.0), ("m", 60.0)], "entity string, minutes double")
    assert [tuple(r) for r in lk.conflicts(links, texts, minutes, "id", "text").collect()] == [(1, "b", "fringe_but_discussed", 35.0), (2, "b", "fringe_but_discussed", 35.0), (3, "b", "fringe_but_discussed", 35.0), (1, "a", "sure_but_doubted", 15.0)]


def test_empty(spark):
    none = spark.createDataFrame([], "name string, kind string, entity string")
    assert lk.mentions(spark.createDataFrame([(1, "a b")], "id long, text string"), none, "id", "text").collect() == []


def test_plain_letters_are_those_of_the_collation(spark):
    """Every character of the table equals its text under the collation; no other one equals a character of ASCII; texts of several are equal where the collation says so."""
    known = {c: to for c, to in letters().items() if c != "ı"}
    rows = spark.createDataFrame(list(known.items()), "c string, to string").repartition(8)
    assert rows.where(F.collate("c", COLLATION) != F.collate("to", COLLATION)).count() == 0
    others = [(chr(c),) for c in [*range(128, 0xD800), *range(0xE000, 0x20000)] if chr(c) not in known]
    plain = [(chr(c),) for c in [9, 10, 11, 12, 13, *range(32, 127)]] + [("",)]
    assert spark.createDataFrame(others, "c string").repartition(8).join(spark.createDataFrame(plain, "to string"), F.collate("c", COLLATION) == F.collate("to", COLLATION)).count() == 0
    rng = random.Random(7)
    pools = ["aeiosuAEIOSU", "éÈñßÆœŁøﬁ⑩", [c for c in known], "αΩйЖи汉ツ", "\u0301\u0306\u0308"]
    text = lambda: "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 4)))
    texts = [text() for _ in range(3000)]
    pairs = [(a, rng.choice([text(), a.upper(), plain_key(a), unicodedata.normalize("NFD", a), "".join(known.get(c, c) for c in a)])) for a in texts]
    same = lambda f: f(F.trim("a")) == f(F.trim("b"))
    made = spark.createDataFrame(pairs, "a string, b string").select("a", "b", same(folded).alias("ours"), same(lambda c: F.collate(c, COLLATION)).alias("theirs"))
    assert made.where("ours != theirs").limit(5).collect() == [] and made.where("theirs").count() > 500


def test_texts_of_one_file_are_shared_out(spark):
    texts = spark.range(40).select("id", F.lit("Da Silva van Dijk").alias("text")).coalesce(1)
    found = lk.mentions(texts, spark.createDataFrame([("da silva", "player", "1"), ("Dijk", "player", "2")], "name string, kind string, entity string"), "id", "text")
    assert found.count() == 80 and "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_documents_are_shared_out_and_spellings_folded_once(spark, small):
    from fieldglass.plans.all_queries import QUERIES

    found = QUERIES["f1_fold"](spark, small)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    words = [(r["lang"], w) for r in spark.read.parquet(f"{small}/documents.parquet").collect() for w in re.findall(r"\w+", (r["text"] or "").replace("_", " "))]
    keys = {(lang, plain_key(w).replace("ß", "ss")) for lang, w in words}
    assert {r["lang"]: r["keys"] for r in found.collect()} == {lang: sum(k[0] == lang for k in keys) for lang in {k[0] for k in keys}}
