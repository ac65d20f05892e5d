"""The driver's catalogue: each query in the dialect, with names for its columns, and its SQL."""

from __future__ import annotations

import json
import subprocess
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import Session
from millrace.sources.lock import holder
from millrace.sources.shared import shared_root, temporary
from millrace.sources.storage import StorageError

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

#: name: (statement, its columns' names or None, SQL or None where the statement itself is SQL)
SELECTS: dict[str, tuple[str, list[str] | None, str | None]] = {
    "q_flag": ("SELECT l_returnflag, AVG(l_extendedprice), COUNT(*) FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag HAVING COUNT(*) > 10 ORDER BY AVG(l_extendedprice) DESC LIMIT 5", ["l_returnflag", "avg_price", "cnt"],
               "SELECT l_returnflag, AVG(l_extendedprice) AS avg_price, COUNT(*) AS cnt FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag HAVING COUNT(*) > 10 ORDER BY avg_price DESC LIMIT 5"),
    "scan_star": ("SELECT * FROM nation", None, None),
    "project_cols": ("SELECT o_orderkey, o_totalprice FROM orders", None, None),
    "project_arith": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) FROM lineitem", ["l_orderkey", "l_linenumber", "revenue"], "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem"),
    "arith_int_div": ("SELECT p_partkey, p_size / 7 FROM part", ["p_partkey", "r"], "SELECT p_partkey, CAST(p_size AS DOUBLE) / 7 AS r FROM part"),
    "unary_minus": ("SELECT c_custkey, -c_acctbal FROM customer", ["c_custkey", "neg"], "SELECT c_custkey, -c_acctbal AS neg FROM customer"),
    "quoted_names": ('SELECT "o_orderkey", $o_orderstatus$ FROM "orders"', None, "SELECT o_orderkey, o_orderstatus FROM orders"),
    "filter_lit": ("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 4000", None, None),
    "filter_str": ("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", None, None),
    "filter_ne": ("SELECT p_partkey FROM part WHERE p_size != 10", None, None),
    "filter_int_dec": ("SELECT p_partkey FROM part WHERE p_size > 10.5", None, None),
    "filter_col_col": ("SELECT COUNT(*) FROM lineitem WHERE l_suppkey = l_partkey", ["cnt"], "SELECT COUNT(*) AS cnt FROM lineitem WHERE l_suppkey = l_partkey"),
    "filter_arith": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_extendedprice - l_quantity) > 50000", None, None),
    "filter_and": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20 AND l_linenumber <= 2", None, None),
    "filter_flat_or_and": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 5 OR l_discount > 0.05 AND l_returnflag = 'R'", None, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 OR l_discount > 0.05) AND l_returnflag = 'R'"),
    "div_guard": ("SELECT l_orderkey, l_linenumber, l_extendedprice / l_tax FROM lineitem", ["l_orderkey", "l_linenumber", "ratio"], "SELECT l_orderkey, l_linenumber, l_extendedprice / l_tax AS ratio FROM lineitem WHERE l_tax <> 0"),
    "div_guard_or": ("SELECT COUNT(*) FROM lineitem WHERE l_quantity / l_tax > 100 OR l_quantity > 0", ["cnt"], "SELECT COUNT(*) AS cnt FROM lineitem WHERE l_tax <> 0 AND (l_quantity / l_tax > 100 OR l_quantity > 0)"),
    "point_lookup": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 100", None, None),
    "agg_global": ("SELECT COUNT(*), SUM(l_quantity), AVG(l_quantity), MIN(l_quantity), MAX(l_quantity) FROM lineitem", ["cnt", "s", "a", "mn", "mx"], "SELECT COUNT(*) AS cnt, SUM(l_quantity) AS s, AVG(l_quantity) AS a, MIN(l_quantity) AS mn, MAX(l_quantity) AS mx FROM lineitem"),
    "agg_sum_int": ("SELECT SUM(p_size) FROM part", ["s"], "SELECT CAST(SUM(p_size) AS DOUBLE) AS s FROM part"),
    "agg_arith": ("SELECT (MAX(l_quantity) - MIN(l_quantity)) / AVG(l_quantity) FROM lineitem", ["spread"], "SELECT (MAX(l_quantity) - MIN(l_quantity)) / AVG(l_quantity) AS spread FROM lineitem"),
    "agg_empty": ("SELECT COUNT(*), SUM(l_quantity), AVG(l_quantity), MIN(l_quantity) FROM lineitem WHERE l_quantity > 100000", ["cnt", "s", "a", "mn"], "SELECT COUNT(*) AS cnt, COALESCE(SUM(l_quantity), 0) AS s, COALESCE(AVG(l_quantity), 0) AS a, COALESCE(MIN(l_quantity), 0) AS mn FROM lineitem WHERE l_quantity > 100000"),
    "agg_minmax_str": ("SELECT MIN(c_name), MAX(c_name) FROM customer", ["mn", "mx"], "SELECT MIN(c_name) AS mn, MAX(c_name) AS mx FROM customer"),
    "group_one": ("SELECT l_returnflag, COUNT(*), SUM(l_quantity) FROM lineitem GROUP BY l_returnflag", ["l_returnflag", "cnt", "s"], "SELECT l_returnflag, COUNT(*) AS cnt, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag"),
    "group_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*) FROM lineitem GROUP BY l_returnflag, l_linestatus", ["l_returnflag", "l_linestatus", "cnt"], "SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "group_int_key_order": ("SELECT p_size, COUNT(*) FROM part GROUP BY p_size ORDER BY p_size", ["p_size", "cnt"], "SELECT p_size, COUNT(*) AS cnt FROM part GROUP BY p_size ORDER BY p_size"),
    "having": ("SELECT o_orderpriority, AVG(o_totalprice), COUNT(*) FROM orders GROUP BY o_orderpriority HAVING AVG(o_totalprice) > 6 ORDER BY AVG(o_totalprice) DESC", ["o_orderpriority", "a", "cnt"], "SELECT o_orderpriority, AVG(o_totalprice) AS a, COUNT(*) AS cnt FROM orders GROUP BY o_orderpriority HAVING AVG(o_totalprice) > 6 ORDER BY a DESC"),
    "having_only_agg": ("SELECT o_orderpriority FROM orders GROUP BY o_orderpriority HAVING COUNT(*) > 3000", None, None),
    "having_no_group": ("SELECT p_partkey FROM part HAVING p_size > 40", None, "SELECT p_partkey FROM part WHERE p_size > 40"),
    "distinct_one": ("SELECT DISTINCT c_mktsegment FROM customer", None, None),
    "distinct_multi": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem ORDER BY l_returnflag, l_linestatus", None, None),
    "order_expr": ("SELECT p_partkey, p_retailprice - p_size FROM part ORDER BY (p_retailprice - p_size) DESC", ["p_partkey", "d"], "SELECT p_partkey, p_retailprice - p_size AS d FROM part ORDER BY (p_retailprice - p_size) DESC"),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None, None),
    "order_hidden_col": ("SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", None, None),
    "limit_zero": ("SELECT r_name FROM region LIMIT 0", None, "SELECT r_name FROM region"),
    "join_two": ("SELECT customer.c_name, nation.n_name FROM customer JOIN nation ON customer.c_nationkey = nation.n_nationkey", ["c_name", "n_name"], None),
    "join_inner_filter": ("SELECT COUNT(*) FROM orders INNER JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", ["cnt"], "SELECT COUNT(*) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"),
    "join_mixed_key": ("SELECT COUNT(*) FROM customer JOIN part ON customer.c_nationkey = part.p_partkey", ["cnt"], "SELECT COUNT(*) AS cnt FROM customer JOIN part ON customer.c_nationkey = part.p_partkey"),
    "join_three_group": ("SELECT r_name, COUNT(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", ["r_name", "cnt"], "SELECT r_name, COUNT(*) AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "join_lineitem_orders": ("SELECT o_orderpriority, COUNT(*), MAX(l_quantity) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority", ["o_orderpriority", "cnt", "mx"], "SELECT o_orderpriority, COUNT(*) AS cnt, MAX(l_quantity) AS mx FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"),
}


#: Sums and means of doubles, which no two engines add in one order: both sides are compared to four digits.
ROUNDED = {"q_flag": ["avg_price"], "agg_global": ["s", "a"], "agg_arith": ["spread"], "group_one": ["s"], "having": ["a"]}


def _select(name: str, statement: str, names: list[str] | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Session(spark).register_folder(sf_dir, [t for t in TABLES if t in statement]).sql(statement)
        df = df.toDF(*names) if names else df
        return df.withColumns({c: F.round(c, 4) for c in ROUNDED.get(name, [])})

    return run


def _stored(spark: SparkSession, sf_dir: str, *tables: str) -> Session:
    """A session on a new folder, in the cluster's shared one if it names one, with these tables imported."""
    session = Session(spark, temporary(spark, f"{shared_root(spark)}/millrace-db-{uuid.uuid4().hex}"))
    for t in tables:
        session.import_table(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return session


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "customer")
    s.sql("UPDATE customer SET c_acctbal = 0.0 WHERE c_mktsegment = 'BUILDING'")
    return s.sql("SELECT c_custkey, c_acctbal FROM customer")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "customer")
    s.sql("DELETE FROM customer WHERE c_acctbal < 0")
    return s.sql("SELECT c_custkey, c_acctbal FROM customer")


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "region")
    s.sql("INSERT INTO region (r_regionkey, r_name) VALUES (99, 'NEWLAND')")
    return s.sql("SELECT * FROM region")


def ddl_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir)
    s.sql("CREATE TABLE t (id INT, name VARCHAR, PRIMARY KEY(id))")
    s.sql("CREATE INDEX by_name ON t(name)")
    s.sql("INSERT INTO t (id, name) VALUES (1, 'one')")
    s.sql("INSERT INTO t VALUES (-2, '007')")
    return s.sql("SELECT id, name FROM t")


def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "nation")
    s.sql("BEGIN")
    s.sql("DELETE FROM nation")
    s.sql("ROLLBACK")
    return s.sql("SELECT * FROM nation")


def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "nation")
    s.sql("BEGIN")
    s.sql("DELETE FROM nation WHERE n_regionkey = 1")
    s.sql("UPDATE nation SET n_name = 'X' WHERE n_regionkey = 2")
    s.sql("COMMIT")
    return s.sql("SELECT * FROM nation")


def export_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "region")
    path = f"{s.store.root}/region.csv"
    s.sql(f"EXPORT {path} SELECT r_regionkey, r_name FROM region")
    s.sql(f"LOAD again {path} 0 r_regionkey")
    return s.sql("SELECT r_regionkey, r_name FROM again")


def refused(s: Session, statement: str) -> int:
    """1 if the stored tables do not allow it."""
    try:
        s.sql(statement)
    except StorageError:
        return 1
    return 0


def pk_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key is unique through INSERT and UPDATE; a change that keeps it so goes through."""
    s = Session(spark, temporary(spark, f"{shared_root(spark)}/millrace-db-{uuid.uuid4().hex}"))
    s.import_table("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey")
    bad = [refused(s, x) for x in ("INSERT INTO nation VALUES (3, 'AGAIN', 1)", "UPDATE nation SET n_nationkey = 4 WHERE n_nationkey = 5", "UPDATE nation SET n_nationkey = 99")]
    s.sql("UPDATE nation SET n_nationkey = 77 WHERE n_nationkey = 5")
    s.sql("INSERT INTO nation VALUES (5, 'NEW', 1)")
    return s.sql("SELECT n_nationkey, n_name FROM nation").withColumn("refused", F.lit(sum(bad)))


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equality on an indexed column of a stored table, which has changed since."""
    s = _stored(spark, sf_dir, "orders")
    s.sql("CREATE INDEX by_customer ON orders(o_custkey)")
    s.sql("UPDATE orders SET o_orderstatus = 'X' WHERE o_custkey = 7")
    s.sql("DELETE FROM orders WHERE o_custkey = 8")
    return s.sql("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7")


def txn_dead_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer ends in the middle of its transaction: its changes are not seen, and the next writer goes on."""
    s = _stored(spark, sf_dir, "nation")
    s.sql("BEGIN")
    s.sql("DELETE FROM nation")
    gone = subprocess.Popen([sys.executable, "-c", "input()"], stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    s.store.files.write(f"{s.store.root}/LOCK", [json.dumps(holder(gone.pid, "of a process that is gone"))])
    gone.communicate()
    other = Session(spark, s.store.root)
    other.sql("UPDATE nation SET n_name = 'X' WHERE n_regionkey = 2")
    refused(s, "COMMIT")  # the first one has lost its lock
    return other.sql("SELECT * FROM nation")


def txn_disconnect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing a session undoes its open transaction."""
    s = _stored(spark, sf_dir, "nation")
    s.sql("BEGIN")
    s.sql("DELETE FROM nation WHERE n_regionkey = 1")
    s.close()
    other = Session(spark, s.store.root)
    other.sql("DELETE FROM nation WHERE n_regionkey = 0")
    return other.sql("SELECT * FROM nation")


def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader sees the table as it was when it began, while others change it; a second writer has to wait."""
    s = _stored(spark, sf_dir, "nation")
    before = s.sql("SELECT * FROM nation")
    s.sql("BEGIN")
    s.sql("DELETE FROM nation WHERE n_regionkey = 1")
    waits = refused(Session(spark, s.store.root), "DELETE FROM nation")
    s.sql("COMMIT")
    Session(spark, s.store.root).sql("UPDATE nation SET n_name = 'X'")
    return before.withColumn("refused", F.lit(waits))


def result_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that results have, by statement and place."""
    s = Session(spark).register_folder(sf_dir, TABLES)
    statements = ["SELECT p_size, (p_size + 1), -p_size, p_size * 2 FROM part", "SELECT COUNT(*), AVG(p_size), MAX(p_size) - MIN(p_size) FROM part", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey"]
    return spark.createDataFrame([(i, k, c) for i, x in enumerate(statements) for k, c in enumerate(s.sql(x).columns)], "statement int, place int, name string")


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark).sql("EXPLAIN SELECT DISTINCT l_returnflag, COUNT(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 10 AND o_orderstatus = 'F' GROUP BY l_returnflag HAVING COUNT(*) > 5 ORDER BY l_returnflag LIMIT 3")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stored(spark, sf_dir, "region")
    s.sql("CREATE TABLE t (id INT, name VARCHAR, PRIMARY KEY(id))")
    s.sql("CREATE INDEX by_name ON t(name)")
    return s.sql("DEBUG")


_NAMES = [["p_size", "(p_size + 1)", "(-p_size)", "(p_size * 2)"], ["Count(*)", "Avg(p_size)", "(Max(p_size) - Min(p_size))"], ["n_name"], ["nation.n_nationkey", "nation.n_name", "nation.n_regionkey", "region.r_regionkey", "region.r_name"]]
_STEPS = ["TableScan lineitem", "TableScan orders", "Join l_orderkey = o_orderkey", "Filter l_quantity > 10 AND o_orderstatus = 'F'", "GroupBy [l_returnflag] [Count(*)]", "Having Count(*) > 5", "OrderBy l_returnflag ASC", "Projection l_returnflag, Count(*)", "Distinct", "Limit 3"]


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


_CHANGES = {
    "dml_update": (dml_update, "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer"),
    "dml_delete": (dml_delete, "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal < 0)"),
    "dml_insert": (dml_insert, "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEWLAND'"),
    "ddl_create": (ddl_create, "SELECT CAST(1 AS INTEGER) AS id, 'one' AS name UNION ALL SELECT -2, '007'"),
    "txn_rollback": (txn_rollback, "SELECT * FROM nation"),
    "txn_commit": (txn_commit, "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 1"),
    "export_load": (export_load, "SELECT r_regionkey, r_name FROM region"),
    "pk_unique": (pk_unique, "SELECT CASE WHEN n_nationkey = 5 THEN 77 ELSE n_nationkey END AS n_nationkey, n_name, 3 AS refused FROM nation UNION ALL SELECT 5, 'NEW', 3"),
    "index_lookup": (index_lookup, "SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7"),
    "txn_dead_writer": (txn_dead_writer, "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation"),
    "txn_disconnect": (txn_disconnect, "SELECT * FROM nation WHERE n_regionkey <> 0"),
    "snapshot_read": (snapshot_read, "SELECT *, 1 AS refused FROM nation"),
    "result_names": (result_names, _values([(i, k, c) for i, names in enumerate(_NAMES) for k, c in enumerate(names)], "statement, place, name")),
    "explain": (explain, _values([(f"-->{x}",) for x in _STEPS], '"EXPLAIN"')),
    "catalog": (catalog, _values([("region", "r_regionkey", "INT", False, False), ("region", "r_name", "VARCHAR", False, False), ("t", "id", "INT", True, True), ("t", "name", "VARCHAR", False, True)], '"table", "column", "type", primary_key, indexed')),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _select(name, statement, names) for name, (statement, names, _) in SELECTS.items()} | {name: f for name, (f, _) in _CHANGES.items()}


def oracle_sql() -> dict[str, str]:
    def rounded(name: str, sql: str) -> str:
        if name not in ROUNDED:
            return sql
        return f"SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in ROUNDED[name])}) FROM ({sql})"

    return {name: rounded(name, sql or statement) for name, (statement, _, sql) in SELECTS.items()} | {name: sql for name, (_, sql) in _CHANGES.items() if sql}
