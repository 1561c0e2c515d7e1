"""Claims under all rules against a plain version; feeds' state over shuffled batches and a restart."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import resolution as rs
from fieldglass.streaming import feeds

NOW = dt.datetime(2024, 3, 1)
SCHEMA = "claim_id long, player_id int, claim_type string, value string, claimed_at timestamp_ntz, observed_at timestamp_ntz, source string, tier int, digest string"
LEVEL = {"a": 1.0, "d": 0.75, "i": 0.1, "s": 0.1, "u": 0.0, "n": 0.0}


def number(v):
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def day(v):
    try:
        return dt.date.fromisoformat(v)
    except (TypeError, ValueError):
        return None


def good(c):
    if c["observed_at"] is None or (c["claimed_at"] and c["claimed_at"] > c["observed_at"]) or (c["tier"] >= 2 and not c["digest"]):
        return False
    kind, v = c["claim_type"], c["value"]
    if kind in ("chance_of_playing", "predicted_start"):
        return number(v) is not None and 0 <= number(v) <= (100 if kind == "chance_of_playing" else 1)
    if kind in ("return_date", "unavailable_until"):
        return day(v) is not None
    return kind != "permanent_exit" or bool(json.loads(v).get("kind"))


def hope(c):
    return {"chance_of_playing": lambda v: number(v) / 100, "permanent_exit": lambda v: 0.0, "unavailable_until": lambda v: 0.0, "status": lambda v: LEVEL.get(v.strip().lower())}.get(c["claim_type"], lambda v: None)(c["value"])


def apart(a, b):
    kind = a["claim_type"]
    if kind == "chance_of_playing":
        return abs(number(a["value"]) - number(b["value"])) >= 25
    if kind in ("return_date", "unavailable_until"):
        return abs((day(a["value"]) - day(b["value"])).days) > 7
    if kind == "status":
        return hope(a) is None or hope(b) is None or (hope(a) > 0.5) != (hope(b) > 0.5)
    return a["value"] != b["value"]


def order(c):
    return c["claimed_at"] or c["observed_at"], c["observed_at"], c["claim_id"]


def one(claims):
    """(value, rule, claim_id, unresolved, against) of a player's valid claims of one type, by reading them latest first."""
    rows = sorted(claims, key=order, reverse=True)
    if len(rows) == 1:
        return rows[0]["value"], "only_claim", rows[0]["claim_id"], False, None
    fresh = [c for c in rows if (NOW - order(c)[0]).days <= 21]
    stale = len(fresh) < len(rows)
    last = {}
    for c in fresh or rows:
        last.setdefault(c["source"], c)
    field = sorted(last.values(), key=order, reverse=True)
    if len(field) == 1:
        return field[0]["value"], "fresher_claim_beats_stale" if fresh and stale else "recency_within_source", field[0]["claim_id"], False, None
    tier = min(c["tier"] for c in field)
    top = [c for c in field if c["tier"] == tier]
    rivals = [c for c in top[1:] if apart(top[0], c)]
    if rivals:
        held = min([top[0], *rivals], key=lambda c: 1.0 if hope(c) is None else hope(c))
        return held["value"], "unresolved_conservative", held["claim_id"], True, rivals[0]["claim_id"] if held is top[0] else top[0]["claim_id"]
    for c in field:
        if c["tier"] > tier and order(c) > order(top[0]) and hope(c) is not None and hope(top[0]) is not None:
            if hope(c) < hope(top[0]):
                return c["value"], "asymmetric_override", c["claim_id"], False, top[0]["claim_id"]
            return top[0]["value"], "asymmetric_override_refused", top[0]["claim_id"], False, c["claim_id"]
    return top[0]["value"], "tier_precedence", top[0]["claim_id"], False, None


def plain(claims):
    groups, out = {}, {}
    for c in claims:
        groups.setdefault((c["player_id"], c["claim_type"]), []).append(c)
    for key, rows in groups.items():
        fine = [c for c in rows if good(c)]
        value, rule, claim, unresolved, against = one(fine) if fine else (None, "all_claims_invalid", None, False, None)
        out[key] = [value, rule, claim, max(len(fine) - 1, 0), len(rows) - len(fine), unresolved, against]
    for player, kind in list(out):
        if kind == "permanent_exit" and out[player, kind][0] is not None and (player, "chance_of_playing") in out:
            held = out[player, "chance_of_playing"]
            held[0], held[1], held[5], held[6] = "0", "permanence_beats_gradation", False, None
    return sorted((*k, *v) for k, v in out.items())


def made(seed, n=700):
    rng, rows = random.Random(seed), []
    for i in range(n):
        kind = rng.choice(["chance_of_playing", "chance_of_playing", "status", "return_date", "unavailable_until", "predicted_start", "permanent_exit"])
        value = {
            "chance_of_playing": lambda: rng.choice(["0", "25", "50", "75", "100", "130", "soon", None]), "status": lambda: rng.choice([*"adisun", "A ", "x"]),
            "predicted_start": lambda: rng.choice(["0.1", "0.9", "2"]), "permanent_exit": lambda: rng.choice(['{"kind": "sold"}', "{}", "{}", "{}"]),
        }.get(kind, lambda: rng.choice(["2024-03-05", "2024-03-09", "2024-03-20", "later"]))()
        seen = NOW - dt.timedelta(days=rng.choice([0, 1, 5, 20, 21, 22, 40]), hours=rng.randrange(48))
        claimed = rng.choice([None, seen, seen - dt.timedelta(hours=rng.randrange(60)), seen + dt.timedelta(hours=1)])
        rows.append(dict(claim_id=i, player_id=rng.choice([None, *range(25)]) and rng.randrange(25), claim_type=kind, value=value, claimed_at=claimed, observed_at=rng.choice([seen] * 9 + [None]), source=rng.choice("abcd"), tier=rng.randrange(1, 4), digest=rng.choice(["d", "d", "d", "", None])))
    return [r | {"player_id": r["player_id"] if r["player_id"] is not None else 99} for r in rows]


@pytest.mark.parametrize("parts", [1, 7])
def test_all_rules_equal_reading_claims_one_by_one(spark, parts):
    for seed in range(3):
        claims = made(seed)
        table = spark.createDataFrame([tuple(c.values()) for c in claims], SCHEMA).repartition(parts)
        got = rs.resolve(table, F.lit(NOW).cast("timestamp_ntz"))
        rows = sorted(tuple(r) for r in got.select("player_id", "claim_type", "value", "rule", "claim_id", "beaten", "dropped", "unresolved", "against").collect())
        assert rows == plain(claims)
        if not seed:
            assert len({r[3] for r in rows}) >= 9
            fates = {r["claim_id"]: r["fate"] for r in rs.fates(table, got).collect()}
            assert len(fates) == len(claims)
            for c in claims:
                assert (fates[c["claim_id"]] in ("used", "beaten")) == good(c)
            assert sum(f == "used" for f in fates.values()) == sum(r[4] is not None for r in rows)


def test_resolution_of_an_empty_table(spark):
    assert rs.resolve(spark.createDataFrame([], SCHEMA), F.lit(NOW).cast("timestamp_ntz")).collect() == []


RULES = feeds.Rules(interval=600_000, escalate=2, silent=3_600_000)
START = dt.datetime(2024, 1, 1)


def polls(n=160):
    rng = random.Random(4)
    rows = [(f"f{rng.randrange(4)}", START + dt.timedelta(seconds=90 * i + rng.randrange(60), milliseconds=rng.randrange(1000)), i, rng.choice(["fetched", "not_modified", "failed", "failed"])) for i in range(n)]
    return [r for r in rows if not (r[0] == "f3" and 40 < r[2] < 110)] + [("f9", START + dt.timedelta(hours=9), n, "fetched")]


def ms(t):
    return round((t - START).total_seconds() * 1000)


def plain_feeds(rows, mark):
    out = []
    for feed in {r[0] for r in rows}:
        attempt = success = None
        failures, told = 0, False
        for _, at, poll_id, outcome in sorted((r for r in rows if r[0] == feed and ms(r[1]) < mark), key=lambda r: (r[1], r[2])):
            t = ms(at)
            if success is not None and not told and success + RULES.silent <= t:
                told = True
                out.append((feed, success + RULES.silent, None, "silent", failures, True))
            if attempt is not None and t - attempt < RULES.interval:
                out.append((feed, t, poll_id, "skipped_interval", failures, False))
                continue
            attempt = t
            if outcome == "failed":
                failures += 1
            else:
                failures, success, told = 0, t, False
            out.append((feed, t, poll_id, outcome, failures, outcome == "failed" and failures >= RULES.escalate))
        if success is not None and not told and success + RULES.silent < mark:
            out.append((feed, success + RULES.silent, None, "silent", failures, True))
    return sorted(out, key=str)


def test_feeds_over_shuffled_batches_and_a_restart_equal_the_plain_rule(spark, tmp_path):
    rows, schema, folder = polls(), "feed string, at timestamp, poll_id long, outcome string", str(tmp_path / "in")
    rng = random.Random(1)

    def write(part):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return feeds.replay(feeds.outcomes(stream, RULES, "2 hours"), str(tmp_path / "out"))

    for at in (0, 40):  # rows move within a batch and to the next one, inside the delay
        write(rows[at : at + 50 : 2] + rows[at + 1 : at + 40 : 2])
    first = run().count()
    taken = set(rows[0:50:2] + rows[1:40:2] + rows[40:90:2] + rows[41:80:2])
    write([r for r in rows[:120] if r not in taken and r[2] > 70])
    write(rows[120:])
    got = [(r["feed"], ms(r["at"]), r["poll_id"], r["status"], r["failures"], r["escalate"]) for r in run().collect()]
    sent = [r for r in rows if r in taken or r[2] > 70]
    mark = ms(max(r[1] for r in sent)) - 7_200_000
    assert sorted(got, key=str) == plain_feeds(sent, mark) and 0 < first < len(got)
    assert {r[3] for r in got} == {"fetched", "not_modified", "failed", "skipped_interval", "silent"} and any(r[5] and r[3] == "failed" for r in got)
