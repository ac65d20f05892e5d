import json
import os
import subprocess
import sys
import time
from pathlib import Path

import pytest

from millrace.session import Session
from millrace.sources.csv import CsvError, infer
from millrace.sources.lock import LEASE
from millrace.sources.storage import StorageError


@pytest.fixture
def session(spark, tmp_path):
    s = Session(spark, str(tmp_path / "db"))
    yield s
    s.close()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def made(s):
    s.sql("CREATE TABLE t (id INT, v VARCHAR, PRIMARY KEY(id))")
    for i, v in ((1, "a"), (2, "b"), (3, "c")):
        s.sql(f"INSERT INTO t (id, v) VALUES ({i}, '{v}')")
    return s


def test_changes(session):
    s = made(session)
    assert s.sql("UPDATE t SET v = 'x' WHERE id > 1").first()[0] == 2
    assert rows(s.sql("SELECT * FROM t")) == [(1, "a"), (2, "x"), (3, "x")]
    assert s.sql("DELETE FROM t WHERE v = 'x' AND id = 2").first()[0] == 1
    assert rows(s.sql("SELECT id FROM t")) == [(1,), (3,)]
    assert s.sql("DELETE FROM t").first()[0] == 2 and rows(s.sql("SELECT * FROM t")) == []


def test_keys(session):
    s = made(session)
    with pytest.raises(StorageError):
        s.sql("INSERT INTO t (id, v) VALUES (1, 'again')")
    with pytest.raises(StorageError):
        s.sql("UPDATE t SET id = 7")
    assert s.sql("UPDATE t SET id = 7 WHERE id = 1").first()[0] == 1
    assert rows(s.sql("SELECT id FROM t")) == [(2,), (3,), (7,)]


def test_types(session):
    session.sql("CREATE TABLE u (a UTINYINT, b USMALLINT, c UINT, d UBIGINT, e TINYINT, f DOUBLE, g CHAR)")
    session.sql("INSERT INTO u VALUES (255, 65535, 4294967295, 18446744073709551615, -128, 1.5, '007')")
    r = session.sql("SELECT * FROM u").first()
    assert [int(x) for x in r[:5]] == [255, 65535, 4294967295, 18446744073709551615, -128] and r.g == "007"
    assert session.sql("SELECT SUM(a), AVG(b), SUM(c) FROM u").first()[:] == (255.0, 65535.0, 4294967295.0)
    for bad in ("256, 1, 1, 1, 1, 1, 'x'", "1, 1, 1, -1, 1, 1, 'x'", "1, 1, 1, 1, 200, 1, 'x'", "1.5, 1, 1, 1, 1, 1, 'x'", "1, 2"):
        with pytest.raises(StorageError):
            session.sql(f"INSERT INTO u VALUES ({bad})")


def test_create_errors(session):
    made(session)
    for bad in ("CREATE TABLE t (a INT)", "CREATE TABLE w (a INT, a INT)", "CREATE TABLE w (a NUMBER)", "CREATE TABLE w (a INT, PRIMARY KEY(b))", "CREATE INDEX ON t(nope)", "CREATE INDEX ON t(id)", "INSERT INTO t (id) VALUES (9)", "INSERT INTO nowhere VALUES (1)"):
        with pytest.raises(StorageError):
            session.sql(bad)
    session.sql("CREATE INDEX some_name ON t(v)")
    with pytest.raises(StorageError):
        session.sql("CREATE INDEX ON t(v)")
    assert rows(session.sql("SELECT id FROM t WHERE v = 'b'")) == [(2,)]


def test_transactions(spark, session, tmp_path):
    s = made(session)
    other = Session(spark, str(tmp_path / "db"))
    s.sql("BEGIN")
    s.sql("DELETE FROM t WHERE id = 1")
    assert rows(s.sql("SELECT id FROM t")) == [(2,), (3,)] and rows(other.sql("SELECT id FROM t")) == [(1,), (2,), (3,)]
    with pytest.raises(StorageError):
        other.sql("DELETE FROM t")
    with pytest.raises(StorageError):
        s.sql("BEGIN")
    with pytest.raises(StorageError):
        s.sql("INSERT INTO t VALUES (2, 'dup')")
    assert s.info() == "transaction"
    s.sql("ROLLBACK")
    assert rows(s.sql("SELECT id FROM t")) == [(1,), (2,), (3,)] and s.info() == "auto-commit"
    s.sql("BEGIN")
    s.sql("UPDATE t SET v = 'z'")
    s.sql("COMMIT")
    assert {r.v for r in other.sql("SELECT v FROM t").collect()} == {"z"}
    with pytest.raises(StorageError):
        s.sql("COMMIT")


def test_a_reader_outlives_changes_and_other_sessions(spark, session, tmp_path):
    s = made(session)
    before = s.sql("SELECT id, v FROM t")
    s.sql("UPDATE t SET v = 'new'")
    other = Session(spark, str(tmp_path / "db"))
    other.sql("DELETE FROM t WHERE id = 1")
    assert rows(before) == [(1, "a"), (2, "b"), (3, "c")] and rows(other.sql("SELECT id FROM t")) == [(2,), (3,)]
    assert s.vacuum() == 0  # all of it is young
    s.begin()
    with pytest.raises(StorageError):
        s.vacuum()
    s.sql("UPDATE t SET v = 'lost'")
    s.rollback()
    time.sleep(0.01)
    assert s.vacuum(0) > 0 and rows(other.sql("SELECT id, v FROM t")) == [(2, "new"), (3, "new")] and other.vacuum(0) == 0


WRITER = """
import os, sys
sys.path.insert(0, sys.argv[2])
from pyspark.sql import SparkSession
from millrace.session import Session
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
s = Session(spark, sys.argv[1])
s.sql("BEGIN")
s.sql("DELETE FROM t")
os.kill(os.getpid(), 9)
"""


def test_a_writer_that_dies_blocks_nobody(session, tmp_path):
    s = made(session)
    done = subprocess.run([sys.executable, "-c", WRITER, str(tmp_path / "db"), str(Path(__file__).parent.parent)], capture_output=True, text=True, timeout=120)
    assert done.returncode == -9 and (tmp_path / "db" / "LOCK").exists()
    assert rows(s.sql("SELECT id FROM t")) == [(1,), (2,), (3,)]
    s.sql("DELETE FROM t WHERE id = 2")
    assert rows(s.sql("SELECT id FROM t")) == [(1,), (3,)] and not (tmp_path / "db" / "LOCK").exists()


def test_a_lock_expires_and_its_holder_cannot_publish(spark, session, tmp_path):
    s = made(session)
    other = Session(spark, str(tmp_path / "db"))
    s.begin()
    s.sql("DELETE FROM t")
    with pytest.raises(StorageError):
        other.sql("DELETE FROM t WHERE id = 1")
    lock = tmp_path / "db" / "LOCK"
    s.store.files.write(str(lock), [json.dumps(json.loads(lock.read_text()) | {"host": "another"})])
    with pytest.raises(StorageError):
        other.sql("DELETE FROM t WHERE id = 1")
    os.utime(lock, (0, time.time() - 2 * LEASE))  # as of a host that has not renewed it
    other.sql("DELETE FROM t WHERE id = 1")
    with pytest.raises(StorageError):
        s.commit()
    assert rows(s.sql("SELECT id FROM t")) == [(2,), (3,)]
    s.sql("DELETE FROM t WHERE id = 2")
    assert rows(other.sql("SELECT id FROM t")) == [(3,)]
    s.begin()
    s.close()
    other.sql("DELETE FROM t")
    other.store.files.write(str(lock), ["{broken"])
    with pytest.raises(StorageError):
        other.sql("INSERT INTO t VALUES (9, 'x')")
    os.utime(lock, (0, time.time() - 2 * LEASE))
    other.sql("INSERT INTO t VALUES (9, 'x')")
    assert rows(other.sql("SELECT id FROM t")) == [(9,)]


def test_changes_rewrite_only_files_with_matches(spark, session):
    df = spark.range(0, 4000, 1, 8).selectExpr("CAST(id AS INT) AS id", "CAST(id % 7 AS STRING) AS v")
    session.import_table("f", df, "id")
    before = {f for f, _ in session.store.now["f"].files}
    assert len(before) == 8
    assert session.sql("UPDATE f SET v = 'x' WHERE id = 10").first()[0] == 1
    after = {f for f, _ in session.store.now["f"].files}
    assert len(before & after) == 7
    assert session.sql("DELETE FROM f WHERE id >= 500 AND id < 1000").first()[0] == 500
    last = {f for f, _ in session.store.now["f"].files}
    assert len(after & last) == 7
    assert session.sql("DELETE FROM f WHERE id = -1").first()[0] == 0 and {f for f, _ in session.store.now["f"].files} == last
    assert session.sql("SELECT COUNT(*), SUM(id) FROM f WHERE v != 'x'").first()[:] == (3499, float(sum(range(4000)) - sum(range(500, 1000)) - 10))
    with pytest.raises(StorageError):
        session.sql("UPDATE f SET id = 11 WHERE id = 3999")


def test_inserts_merge_small_files_only(spark, session, monkeypatch):
    monkeypatch.setattr("millrace.sources.storage.SMALL_BYTES", 3000)
    session.import_table("m", spark.range(0, 3000, 1, 2).selectExpr("CAST(id AS INT) AS a"))
    large = {f for f, _ in session.store.now["m"].files}
    for i in range(18):
        session.sql(f"INSERT INTO m VALUES ({-i - 1})")
    files = {f for f, _ in session.store.now["m"].files}
    assert large <= files and len(files) < 10 and len(rows(session.sql("SELECT a FROM m"))) == 3018


def scanned(df):
    """Rows that the scan gave, once the query has run."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_an_indexed_look_up_skips_files(spark, session):
    df = spark.range(0, 20000, 1, 4).selectExpr("CAST(id AS INT) AS id", "CAST((id * 7919) % 20000 AS INT) AS k")
    session.import_table("i", df)
    look = "SELECT id FROM i WHERE k = 7919"
    assert rows(session.sql(look)) == [(1,)] and scanned(session.sql(look)) > 10000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        session.sql("CREATE INDEX ON i(k)")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(session.store.now["i"].files) > 1
    assert rows(session.sql(look)) == [(1,)] and scanned(session.sql(look)) <= 20000 // len(session.store.now["i"].files) + 600
    for x in range(30):  # changes keep it right
        session.sql(f"UPDATE i SET id = {100000 + x} WHERE k = {x * 3}")
    session.sql("DELETE FROM i WHERE k = 6")
    assert [rows(session.sql(f"SELECT id FROM i WHERE k = {k}")) for k in (3, 6, 87)] == [[(100001,)], [], [(100029,)]]
    assert "PushedFilters" in session.physical_plan(look) and "EqualTo(k,7919)" in session.physical_plan(look)


def test_inference():
    assert [infer(x) for x in (["1", " 2 "], ["", ""], ["1", "2.5"], ["3000000000"], ["1", "x"], ["nan", "inf"])] == ["INT", "INT", "FLOAT", "FLOAT", "VARCHAR", "FLOAT"]


def test_load(session, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("id, name,x\n" + "".join(f"{i},n{i},{i}.5\n" for i in range(12)) + "3,dup,1\nbad,z,1\n4.5,z,1\n")
    assert session.load_csv("a", str(f), key="id") == (12, 3)
    assert session.sql("SELECT * FROM a").dtypes == [("id", "int"), ("name", "string"), ("x", "float")]
    assert session.sql("SELECT name FROM a WHERE id = 3").first()[0] == "n3"
    assert session.sql(f"LOAD b {f} 1").first()[0] == 15
    with pytest.raises(StorageError):
        session.sql(f"LOAD a {f} 0")
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(CsvError):
        session.load_csv("r", str(tmp_path / "ragged.csv"))
    (tmp_path / "late.csv").write_text("a,b\n" + "1,2\n" * 30 + "3\n")
    session.begin()
    with pytest.raises(CsvError):
        session.load_csv("late", str(tmp_path / "late.csv"))
    assert "late" not in session.store.now
    session.commit()
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(CsvError):
        session.load_csv("r", str(tmp_path / "empty.csv"))


def test_export(session, tmp_path):
    session.sql("CREATE TABLE e (a DOUBLE, s VARCHAR, f FLOAT)")
    session.sql("INSERT INTO e VALUES (6.0, 'x,\"y', 0.1)")
    session.sql("INSERT INTO e VALUES (100000000000000000000000.0, 'plain', 2)")
    out = tmp_path / "o.csv"
    session.sql(f"EXPORT {out} SELECT a, s, f, a / 4 FROM e ORDER BY a")
    assert out.read_text() == 'a,s,f,(a / 4)\n6,"x,""y",0.1,1.5\n100000000000000000000000,plain,2,25000000000000000000000\n'
    assert session.load_csv("back", str(out), quoted=True) == (2, 0)
