import pytest

from millrace.dialect.lexer import DialectError
from millrace.dialect.nodes import Agg, Binary, Col, Lit, Logic, Select
from millrace.dialect.parser import parse


def test_and_or_are_flat():
    w = parse("SELECT a FROM t WHERE a = 1 OR b = 2 AND c = 3").where
    assert isinstance(w, Logic) and w.op == "AND" and w.left.op == "OR"


def test_parenthesised_conditions():
    w = parse("SELECT a FROM t WHERE a = 1 OR (b = 2 AND (c + 1) > 3)").where
    assert w.op == "OR" and w.right.op == "AND"


def test_precedence_and_names():
    e = parse("SELECT a + b * -2 FROM t").items[0]
    assert e == Binary("+", Col("a"), Binary("*", Col("b"), Lit("int", "-2"))) and str(e) == "(a + (b * -2))"


def test_quoted_names_and_keywords():
    s = parse('select "from", $order$ from "select" where "from" = \'x\';')
    assert s.items == (Col("from"), Col("order")) and s.table == "select"


@pytest.mark.parametrize("join", ["JOIN", "INNER", "INNER JOIN", "inner join"])
def test_joins(join):
    assert parse(f"SELECT * FROM a {join} b ON a.x = b.y").joins[0].table == "b"


def test_aggregates_and_clauses():
    s = parse("SELECT DISTINCT k, COUNT(*), max(t.v) FROM t GROUP BY k HAVING AVG(v) > 1 ORDER BY k DESC, COUNT(*) LIMIT 3")
    assert isinstance(s, Select) and s.distinct and s.limit == 3 and s.items[2] == Agg("max", Col("v", "t")) and [up for _, up in s.order] == [False, True]


@pytest.mark.parametrize("bad", ["", "SELECT", "SELECT a", "SELECT a FROM t WHERE", "SELECT a FROM t LIMIT x", "SELECT SUM(a*b) FROM t", "SELECT a FROM t extra", "CREATE TABLE t (a VARCHAR(5))", "INSERT INTO t VALUES ()", "SELECT a FROM t WHERE a ? 1"])
def test_errors(bad):
    with pytest.raises(DialectError):
        parse(bad)
