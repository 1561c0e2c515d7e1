"""Whitening: eigenpairs against a library's, whole tables against a plain version, exact sums against SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import whitening as wh
from fieldglass.llm.queries import ORACLES, QUERIES


def matrices():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 40):
        x = rng.standard_normal((3 * n, n)) * np.logspace(0, 3, n)
        yield x.T @ x
    q = np.linalg.qr(rng.standard_normal((9, 9)))[0]
    for values in ([5, 5, 5, 5, 5, 1, 1, 1, 1], [3, 3 - 1e-13, 3 - 2e-13, 2, 1, 0, 0, 0, 0], [7, 1, 0, 0, 0, 0, 0, 0, 0], [1e-30] * 9, np.linspace(9, 8, 9)):
        yield q @ np.diag(np.array(values, float)) @ q.T
    yield np.diag([4.0, 4, 4, 4, 4])
    yield np.zeros((4, 4))
    yield np.kron(np.eye(3), np.array([[2.0, 1], [1, 2]]))  # equal pairs in blocks that do not touch


@pytest.mark.parametrize("v", list(matrices()), ids=str)
def test_leading_pairs(v):
    v = (v + v.T) / 2
    values, vectors = wh.leading_pairs(v, 4)
    k, want, size = len(values), np.linalg.eigvalsh(v)[::-1], np.abs(v).max()
    assert k == min(4, len(v)) and np.allclose(values, want[:k], rtol=1e-12, atol=1e-13 * size + 1e-300)
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
    assert np.abs(v @ vectors.T - vectors.T * values).max() <= 1e-12 * size * len(v) + 1e-300


def test_sturm_count():
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal(12), rng.standard_normal(11)
    b[4] = 0
    at = np.linspace(-4, 4, 50)
    values = np.linalg.eigvalsh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
    assert wh.below(a, b, at).tolist() == [(values < x).sum() for x in at]


def plain(rows, k=4):
    """{id: [(component, n, deviation, |whitened|, explained)]} by a library's eigenvectors."""
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = {}
    for d in {len(x) for _, x in good if len(x)}:
        own = [(i, x) for i, x in good if len(x) == d]
        fit = np.array(sorted({tuple(x) for _, x in own}))
        n, s = len(fit), fit.sum(0)
        y = fit - s / n
        v = y.T @ y / n
        values, vectors = np.linalg.eigh(v)
        for i, x in own:
            for c in range(min(k, d)):
                e, u = values[-1 - c], vectors[:, -1 - c]
                out.setdefault(i, []).append((c + 1, n, int(((n * x - s).astype(object) ** 2).sum()), abs((x - s / n) @ u / np.sqrt(e)) if e > d * wh.EPS * np.trace(v) else None, e / np.trace(v) if np.trace(v) > 0 else None))
    return out


def test_whiten_equals_a_plain_version(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.standard_normal(6) * [3, 2, 1, 0.7, 0.4, 0.1] + 5).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(50)]  # repeated vectors count once
    rows += [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (404, [-0.0] * 6), (405, [1.0, 2.0]), (406, [3.0, -2.0]), (407, [1.5, 8.0]), (408, []), (None, [0.5] * 6)]
    got = {}
    out = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    for r in out:
        got.setdefault(r["row"]["vec_id"], []).append((r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"]))
        assert r["identity_error"] < 1e-10
    want = plain(rows)
    assert got.keys() == want.keys()
    for i, made in got.items():
        for a, b in zip(sorted(made), sorted(want[i])):
            assert a[:3] == b[:3] and abs(a[3]) == pytest.approx(b[3], abs=1e-9) and a[4] == pytest.approx(b[4], rel=1e-9)
    # either sign, but one for all rows
    signed = np.array([sorted(got[i])[0][3] for i in range(300)])
    assert np.abs(np.mean(signed)) < 0.5 and (signed < 0).any() and (signed > 0).any()


def test_tables_without_variance(spark):
    make = lambda rows: wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened int"))
    assert make([(1, None, 1)]).collect() == [] and make([(1, [], 1)]).collect() == []
    one = make([(1, [1.0, 2.0], 3), (2, [1.0, 2.0], 4)]).collect()
    assert len(one) == 4 and {(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    line = make([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(5)]).orderBy("row.vec_id", "component").collect()
    assert [r["whitened"] is None for r in line[:3]] == [False, True, True] and line[0]["explained"] == pytest.approx(1) and line[0]["identity_error"] < 1e-12
    assert {r["row"]["whitened"] for r in line} == {0}


def test_sums_beyond_longs_stay_exact(spark):
    rows = [(i, [1e15 + i * 1e12, -3e15, 1e30 if i == 0 else 1.0]) for i in range(40)]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").orderBy("row.vec_id").collect()
    x = [[min(int(256 * c), 2**63 - 1) for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    for r, own in zip(got, x):
        exact = sum((n * c - t) ** 2 for c, t in zip(own, s))
        assert r["deviation"] is None if exact >= 10**38 else int(r["deviation"]) == exact


def test_query_matches_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    cols = "vec_id, component, n, deviation"
    rows = QUERIES["whitening_base"](spark, small).select(*cols.split(", ")).collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"select {cols} from ({ORACLES['whitening_base']})").fetchall())
    whole = QUERIES["op12_whiten"](spark, small)
    assert whole.count() == len(rows) and whole.agg(F.max("identity_error")).first()[0] < 1e-4
