"""Statements over two seeded tables, loaded from CSV into stored tables, against DuckDB."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace.session import Session

N = 2000


def weather(r):
    names = lambda *v: [v[i % len(v)] for i in range(N)]
    made = {"sensor_id": names("WX001", "WX002", "WX003", "WX004"), "region": names("East", "West", "North", "South"),
            "recorded_day": [str(datetime.date(2015, 1, 1) + datetime.timedelta(i)) for i in range(N)]}
    made |= {c: r.uniform(0, high, N).astype(np.float32) for c, high in (("avg_wind", 20), ("rainfall", 5), ("snowfall", 10))}
    return pd.DataFrame(made | {"max_temp": r.integers(0, 100, N).astype(np.int32), "min_temp": r.integers(-20, 80, N).astype(np.int32)})


def taxi(r):
    made = {c: r.integers(a, b, N).astype(np.int32) for c, a, b in (("provider", 1, 4), ("riders", 1, 6), ("start_zone", 100, 300), ("end_zone", 50, 250))}
    made |= {"flagged": np.where(r.random(N) < 0.05, "Y", "N"), "distance_miles": r.uniform(0.5, 15, N).astype(np.float32)}
    return pd.DataFrame(made | {"road_tolls": np.where(r.random(N) < 0.15, r.uniform(0, 12, N), 0).astype(np.float32)})


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder, r = tmp_path_factory.mktemp("seeded"), np.random.default_rng(11)
    session, db = Session(spark, str(folder / "db")), duckdb.connect()
    for name, frame in (("weather", weather(r)), ("taxi", taxi(r))):
        frame.to_csv(folder / f"{name}.csv", index=False)
        session.sql(f"LOAD {name} {folder}/{name}.csv 0")
        db.register(name, frame)
    yield session, db
    session.close()


#: A statement in the dialect, and its SQL where that differs.
STATEMENTS = [
    ("SELECT COUNT(*) FROM weather", None),
    ("SELECT recorded_day, max_temp - min_temp FROM weather WHERE max_temp > 90 AND rainfall < 2.5 ORDER BY recorded_day", None),
    ("SELECT region, COUNT(*), AVG(avg_wind), MIN(min_temp), MAX(max_temp) FROM weather GROUP BY region ORDER BY region", "SELECT region, COUNT(*), AVG(CAST(avg_wind AS DOUBLE)), MIN(min_temp), MAX(max_temp) FROM weather GROUP BY region ORDER BY region"),
    ("SELECT region, sensor_id, SUM(max_temp) FROM weather GROUP BY region, sensor_id HAVING SUM(max_temp) > 24000 ORDER BY region", None),
    ("SELECT DISTINCT provider, flagged FROM taxi ORDER BY provider, flagged", None),
    ("SELECT provider, distance_miles / road_tolls FROM taxi WHERE riders = 5 ORDER BY distance_miles", "SELECT provider, CAST(distance_miles AS DOUBLE) / CAST(road_tolls AS DOUBLE) FROM taxi WHERE riders = 5 AND road_tolls <> 0 ORDER BY distance_miles"),
    ("SELECT start_zone, distance_miles FROM taxi WHERE flagged = 'Y' OR riders > 4 AND provider = 2 ORDER BY distance_miles DESC LIMIT 25", "SELECT start_zone, distance_miles FROM taxi WHERE (flagged = 'Y' OR riders > 4) AND provider = 2 ORDER BY distance_miles DESC LIMIT 25"),
    ("SELECT region, COUNT(*), MAX(distance_miles) FROM taxi JOIN weather ON end_zone = max_temp GROUP BY region ORDER BY region", None),
    ("SELECT a_zone, COUNT(*) FROM taxi WHERE 1 = 2", "error"),
    ("SELECT MAX(distance_miles) - MIN(distance_miles) FROM taxi WHERE riders > 100", "SELECT 0.0"),
]


@pytest.mark.parametrize("statement, sql", STATEMENTS)
def test_against_duckdb(both, statement, sql):
    session, db = both
    if sql == "error":
        with pytest.raises(Exception, match="a_zone"):
            session.sql(statement).collect()
        return
    found, wanted = [tuple(x) for x in session.sql(statement).collect()], db.sql(sql or statement).fetchall()
    assert len(found) == len(wanted) > 0
    for f, w in zip(found, wanted, strict=True):
        assert [pytest.approx(x, rel=1e-6) if isinstance(x, float) else x for x in w] == list(f)


def test_changes_follow(both):
    session, db = both
    session.sql("BEGIN")
    session.sql("UPDATE taxi SET riders = 9 WHERE provider = 1")
    session.sql("DELETE FROM taxi WHERE flagged = 'Y'")
    found = [tuple(x) for x in session.sql("SELECT riders, COUNT(*) FROM taxi GROUP BY riders ORDER BY riders").collect()]
    session.sql("ROLLBACK")
    assert found == db.sql("SELECT CASE WHEN provider = 1 THEN 9 ELSE riders END AS r, COUNT(*) FROM taxi WHERE flagged <> 'Y' GROUP BY r ORDER BY r").fetchall()
    assert session.sql("SELECT COUNT(*) FROM taxi").first()[0] == N
