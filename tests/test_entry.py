import os

import duckdb
import pytest

import __spark_entry__ as driver
from millrace import queries as engine

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def compared(rows):
    return sorted(tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_flagship(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in engine.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = engine.queries()[name](spark, SF)
    other = con.execute(engine.oracle_sql()[name])
    names = [c[0] for c in other.description]
    assert sorted(df.columns) == sorted(names)
    assert compared(df.select(*(f"`{c}`" for c in names)).collect()) == compared(other.fetchall())
