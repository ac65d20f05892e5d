import math

import pytest

from millrace.plans.binder import AnalysisError
from millrace.session import Session


@pytest.fixture(scope="module")
def session(spark):
    s = Session(spark)
    s.register("zeros", spark.createDataFrame([(1, 4.0, 2.0), (2, 1.0, 0.0), (3, 9.0, 3.0)], "id int, a double, b double"))
    s.register("dup", spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string"))
    s.register("big", spark.createDataFrame([(1, "p"), (1, "q"), (3, "r")], "k bigint, w string"))
    s.register("same", spark.createDataFrame([(1, "n"), (2, "m")], "k int, v string"))
    s.register("keys", spark.createDataFrame([(k,) for k in range(12, 0, -1)], "k int"))
    s.register("empty_t", spark.createDataFrame([], "a int, s string"))
    s.register("texts", spark.createDataFrame([("5",), ("abc",), ("B",), ("a",)], "t string"))
    s.register("nulls", spark.createDataFrame([(None, 1), (2, None)], "a int, b int"))
    return s


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_division_by_zero_drops_rows_and_conditions(session):
    assert rows(session.sql("SELECT id, a / b FROM zeros ORDER BY id")) == [(1, 2.0), (3, 3.0)]
    assert rows(session.sql("SELECT id FROM zeros WHERE a / b > 100 OR a > 0 ORDER BY id")) == [(1,), (3,)]
    assert rows(session.sql("SELECT a / b FROM zeros ORDER BY id LIMIT 2")) == [(2.0,), (3.0,)]


def test_arithmetic_is_double(session):
    assert rows(session.sql("SELECT k / 8 FROM keys WHERE k = 12")) == [(1.5,)]
    assert session.sql("SELECT k + 1 FROM keys").dtypes[0][1] == "double"
    assert session.sql("SELECT (k + 1), -k FROM keys").columns == ["(k + 1)", "(-k)"]


def test_texts_in_arithmetic(session):
    assert rows(session.sql("SELECT t + 0 FROM texts WHERE t + 0 = 5")) == [(5.0,)]
    assert rows(session.sql("SELECT t FROM texts WHERE t + 0 < 9")) == [("5",)]
    assert math.isnan(rows(session.sql("SELECT t + 0 FROM texts WHERE t = 'abc'"))[0][0])


def test_comparisons_across_types(session):
    assert rows(session.sql("SELECT t FROM texts WHERE t < 'a' ORDER BY t")) == [("5",), ("B",)]
    assert rows(session.sql("SELECT t FROM texts WHERE t = 5")) == [("5",)]
    assert rows(session.sql("SELECT k FROM keys WHERE k = '7'")) == [(7,)] == rows(session.sql("SELECT k FROM keys WHERE 7.0 = k"))
    assert len(rows(session.sql("SELECT k FROM keys WHERE k > 4.5"))) == 8
    assert rows(session.sql("SELECT k FROM keys WHERE k = 'x'")) == []
    assert rows(session.sql("SELECT dup.k FROM dup JOIN same ON dup.k = same.v")) == []


def test_joins(session):
    got = sorted(rows(session.sql("SELECT v, w FROM dup JOIN big ON dup.k = big.k")))
    assert got == [("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")]
    assert sorted(rows(session.sql("SELECT v, w FROM dup JOIN big ON big.k = dup.k"))) == got
    assert session.sql("SELECT * FROM dup JOIN same ON dup.k = same.k").columns == ["dup.k", "dup.v", "same.k", "same.v"]
    assert rows(session.sql("SELECT dup.v, COUNT(*) FROM dup JOIN same ON dup.k = same.k JOIN big ON dup.k = big.k GROUP BY dup.v ORDER BY dup.v")) == [("x", 2), ("y", 2)]


@pytest.mark.parametrize("bad", ["SELECT nope FROM dup", "SELECT K FROM dup", "SELECT v FROM dup JOIN same ON dup.k = same.k", "SELECT v, COUNT(*) FROM dup GROUP BY k", "SELECT a FROM nowhere", "SELECT k FROM dup WHERE COUNT(*) > 1", "SELECT k FROM dup WHERE x.k = 1"])
def test_analysis_errors(session, bad):
    with pytest.raises(AnalysisError):
        session.sql(bad)


def test_empty_aggregates(session):
    assert rows(session.sql("SELECT COUNT(*), SUM(a), AVG(a), MIN(a), MAX(s) FROM empty_t")) == [(0, 0.0, 0.0, 0, "0")]
    assert rows(session.sql("SELECT s, COUNT(*) FROM empty_t GROUP BY s")) == []
    assert rows(session.sql("SELECT SUM(v), AVG(v), MIN(v) FROM dup")) == [(0.0, 0.0, "x")]


def test_grouping_keeps_types(session):
    assert [r[0] for r in rows(session.sql("SELECT k FROM keys GROUP BY k HAVING k > 9 ORDER BY k"))] == [10, 11, 12]
    assert rows(session.sql("SELECT k FROM dup GROUP BY k HAVING COUNT(*) > 1")) == [(1,)]
    assert rows(session.sql("SELECT k FROM dup GROUP BY k ORDER BY MAX(v) DESC")) == [(2,), (1,)]
    assert rows(session.sql("SELECT (MAX(k) - MIN(k)) / AVG(k) FROM keys")) == [(11 / 6.5,)]


def test_order_distinct_limit(session):
    assert [r[0] for r in rows(session.sql("SELECT k FROM keys ORDER BY 0 - k LIMIT 3"))] == [12, 11, 10]
    assert len(rows(session.sql("SELECT k FROM keys LIMIT 0"))) == 12
    assert rows(session.sql("SELECT DISTINCT k FROM dup ORDER BY v, k DESC")) == [(2,), (1,)]
    assert rows(session.sql("SELECT v FROM dup ORDER BY k DESC, v")) == [("z",), ("x",), ("y",)]


def test_nulls_answer_no(session):
    assert rows(session.sql("SELECT b FROM nulls WHERE a < 5")) == [(None,)]
    assert rows(session.sql("SELECT a FROM nulls WHERE a = b OR b = 1")) == [(None,)]


def test_explain(session):
    got = [r[0] for r in rows(session.sql("EXPLAIN SELECT DISTINCT k FROM dup JOIN big ON dup.k = big.k WHERE v = 'x' LIMIT 2"))]
    assert got == ["-->TableScan dup", "-->TableScan big", "-->Join dup.k = big.k", "-->Filter v = 'x'", "-->Projection k", "-->Distinct", "-->Limit 2"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS v", "id AS unused").write.parquet(str(tmp_path / "t"))
    df = Session(spark).register("t", spark.read.parquet(str(tmp_path / "t"))).sql("SELECT v FROM t WHERE id = 4 AND v > 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,4)" in plan and "unused" not in plan
