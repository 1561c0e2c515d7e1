"""Queries on rows that the given tables have few of or none, against their SQL."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fieldglass.plans.all_queries import ORACLES, QUERIES

from .test_queries import plain


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives its SQL's rows on the tables given, and the rows."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, rows in tables.items():
            pq.write_table(rows, tmp_path / f"{table}.parquet")
            con.execute(f"create or replace view {table} as select * from '{tmp_path}/{table}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        rows, cols, found = df.collect(), sorted(df.columns), con.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
        assert sorted(names) == cols and sorted(tuple(plain(r[c]) for c in cols) for r in rows) == want
        return rows

    return run


def events(rows):
    """rows: (ts, user_id, value)."""
    ids = list(range(len(rows)))
    return pa.table({"event_id": ids, "ts": pa.array([r[0] for r in rows], pa.timestamp("us")), "user_id": [r[1] for r in rows], "event_type": ["click"] * len(ids), "value": [r[2] for r in rows], "props": ['{"k": 1}'] * len(ids)})


def test_phases_change_at_the_second_that_began(same):
    deadline = dt.datetime(2024, 1, 20, 12)
    hours = (-1, 0, 0.5, 4, 48)
    times = [deadline - dt.timedelta(hours=h, microseconds=us) for h in hours for us in (-1_000_001, -1_000_000, -999_999, -1, 0, 1, 999_999, 1_000_000)]
    phases = {r["phase"] for r in same("l12_phase", events=events([(ts, 1, 1.0) for ts in [*times, None] for _ in range(2)]))}
    assert phases == {"settle", "locked", "seal", "refresh", "idle"}


def test_means_on_the_half_of_the_last_place_are_rounded_as_sql_does(same):
    users = [
        [11.29, 73.6, 25.58, 38.83, 8.06, 47.89, 57.41, 10.55], [73.5, 33.8, 38.32, 109.91, 31.32, 20.52, 10.41, 34.15], [25.65, 48.22, 5.05, 78.39, 105.51, 5.38, 80.14, 11.99],
        [55.93, 17.65, 64.62, 9.81, 77.72, 46.58, 68.07, 77.23, 55.27, 84.14, 16.73, 27.9, 66.74, 89.64, 70.99, 101.52],
    ]
    rows = same("v2_glyphs", events=events([(dt.datetime(2024, 1, 1), user, v) for user, values in enumerate(users) for v in values] + [(dt.datetime(2024, 1, 1), 9, None)] * 50))
    assert len(rows) == 5 and {r["mode_at"] for r in rows} == {100.0}
