"""Lexer, fingerprints, parser and writer."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.sql.fingerprint import fingerprint, fnv1a_64, skeleton, statement_kind
from tidemark.sql.lexer import tokenize, unquote_name, unquote_string
from tidemark.sql.parser import ParseError, parse, parse_expression, parse_script, try_parse
from tidemark.sql.tree import dump
from tidemark.sql.writer import quote, to_sql


def test_fnv_vectors():
    assert [f"{fnv1a_64(t):x}" for t in (b"", b"a", b"foobar")] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]


@pytest.mark.parametrize(
    ("sql", "text"),
    [
        ("SELECT * FROM `Orders` WHERE id IN (1, 2, 3) -- note", "select * from orders where id in(?+)"),
        ("insert into t (a,b) VALUES (1,'x'), (2,'y'), (3, NOW())", "insert into t(a, b) values(?+)"),
        ("SELECT COUNT( * ) , MAX(o.total)FROM orders o", "select count(*), max(o.total) from orders o"),
        ("", ""),
        (";;;", ""),
        ("SELECT ((", "select (("),
        ("insert into t values (1,", "insert into t values(?+)"),
        ("INSERT INTO t VALUES(1) ON DUPLICATE KEY UPDATE a = VALUES(a)", "insert into t values(?+) on duplicate key update a = values (a)"),
        ("select -1, a-1, - 2, (+3), x in (-1, NULL, true, ?)", "select ?, a - ?, ?, (?), x in(?+)"),
        ("select a from t where (a,b) in ((1,2),(3,4))", "select a from t where (a, b) in ((?, ?), (?, ?))"),
        ("select 1st_place, .5, t.5, 0x1F, x'ab', n'q', @a /* c */ # z", "select 1st_place, ?, t.?, ?, ?, ?, @a"),
        ("select /*!40001 SQL_NO_CACHE */ 1", "select sql_no_cache ?"),
        ("select 'it''s \\' x', \"a\"\"b\", 'open", "select ?, ?, ?"),
        ("select a--1 from t", "select a - ? from t"),
    ],
)
def test_fingerprint(sql, text):
    assert fingerprint(sql).text == text


def test_fingerprint_id_and_kinds():
    assert fingerprint("SELECT * FROM `Orders` WHERE id IN (1, 2, 3) -- note")[1:] == ("B626FBEF3780CE18", "SELECT")
    kinds = {"select 1": "SELECT", "(select 1)": "SELECT", "values row(1)": "SELECT", "with c as (select 1) update t set a=1": "UPDATE", "truncate t": "DDL", "xa start": "TRANSACTION", "kill 5": "UTILITY", "call p()": "CALL", "?": "UNKNOWN", "": "UNKNOWN"}
    assert {s: statement_kind(tokenize(s)) for s in kinds} == kinds


@given(st.text(alphabet="abAB01 '\"`\\.,;()?@#-/*!\n\téx_$=<>|&:+%\x00", max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text_lexes_parses_and_folds(sql):
    tokens = tokenize(sql)
    assert tokens[-1].kind == "end" and all(sql.startswith(t.text, t.offset) for t in tokens)
    folded = fingerprint(sql)
    assert len(folded.class_id) == 16
    tree, error = try_parse(sql)
    assert (tree is None) == bool(error)


@given(st.lists(st.sampled_from(["select ", "in (", "'", "''", "'a'", "1", "23", " ", ",", ")", "x", "é", ".", "-", "0x1", "n'", "_u", "b'01'", "@", "1e5", "\n", "values", "insert into t ", "=", "#", '"', "--", "$", "`", "`a`", "/*", "*/", "/* c */", "-- x\n", '"q"', "\\", "/*!", "1.5", "`a``b`"]), max_size=25).map("".join))
@settings(max_examples=2500, deadline=None)
def test_skeleton_keeps_the_fingerprint(sql):
    assert fingerprint(skeleton(sql)) == fingerprint(sql)


def test_unquoting():
    assert unquote_name("`a``b`") == "a`b" and unquote_name("x") == "x"
    assert unquote_string(r"'a''b\n\%\q'") == "a'b\n\\%q" and unquote_string("N'x'") == "x"


ROUND = [
    "SELECT DISTINCT a.*, b.c AS `x y`, COUNT(*) AS n, db.t.* FROM t AS a LEFT JOIN u AS b ON a.id = b.id WHERE a.x BETWEEN 1 AND 2 + 3 * 4 AND (b.y LIKE '%z' OR c IS NOT NULL) GROUP BY a WITH ROLLUP HAVING n > 1 ORDER BY n DESC, 2 LIMIT 5, 10 FOR UPDATE",
    "SELECT (a OR b) AND NOT c, (1 + 2) * 3, 1 - (2 - 3), -(a + b), a XOR b, (a, b) IN ((1, 2))",
    "WITH c (n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c) SELECT * FROM c UNION SELECT 2",
    "SELECT CASE a WHEN 1 THEN 'x' ELSE 'y' END, CAST(a AS CHAR(3)), CONVERT(a USING utf8), EXTRACT(YEAR FROM d), MATCH(a, b) AGAINST('x'), j->'$.a', d + INTERVAL 1 DAY",
    "SELECT a FROM (SELECT 1 AS a) AS d WHERE EXISTS (SELECT 1) AND x = ANY (SELECT 2) AND y NOT IN (SELECT 3)",
]


@pytest.mark.parametrize("sql", ROUND)
def test_writing_is_a_fixed_point(sql):
    once = to_sql(parse(sql))
    assert once == sql and to_sql(parse(once)) == once


def test_precedence():
    same = {"a or b and c": "a OR (b AND c)", "not a = b": "NOT (a = b)", "a + b * c ^ d": "a + (b * (c ^ d))", "a | b & c << d": "a | (b & (c << d))", "!a + b": "(NOT a) + b"}
    for plain, grouped in same.items():
        assert parse_expression(plain) == parse_expression(grouped)


def test_errors_and_depth():
    with pytest.raises(ParseError, match="expected an expression but found end of statement at offset 21") as e:
        parse("SELECT a FROM t WHERE")
    assert e.value.offset == 21
    for deep in ("select " + "(" * 5000 + "1", "select " + "-" * 5000 + "x", "select " + "not " * 5000 + "x"):
        assert try_parse(deep)[0] is None
    assert parse("select " + "(" * 40 + "1" + ")" * 40)
    assert try_parse("select é ^")[1].endswith("offset 11")


def test_statements():
    d = parse("DELETE a FROM t a JOIN u USING (id) WHERE a.x = 1 LIMIT 3")
    assert (d.targets, [t.name for t in d.tables], d.joins[0].using) == (["a"], ["t"], ["id"])
    i = parse("INSERT IGNORE INTO s.t (a, b) VALUES (1, 2), (3, 4) ON DUPLICATE KEY UPDATE a = VALUES(a)")
    assert (i.ignore, i.table.schema, i.columns, i.rows, len(i.on_duplicate)) == (True, "s", ["a", "b"], 2, 1)
    c = parse("CREATE TABLE t (id INT UNSIGNED NOT NULL AUTO_INCREMENT, e ENUM('a','b') UNIQUE, PRIMARY KEY (id), KEY k (e(3), id DESC), FULLTEXT KEY f (e), CONSTRAINT c FOREIGN KEY (id) REFERENCES u (id), KEY x ((lower(e)))) ENGINE=InnoDB")
    assert [(x.name, x.type, x.nullable) for x in c.columns] == [("id", "int unsigned", False), ("e", "enum('a','b')", True)]
    assert [(x.name, x.type, x.columns) for x in c.indexes] == [("e", "unique", ["e"]), ("PRIMARY", "primary", ["id"]), ("k", "regular", ["e", "id"]), ("f", "fulltext", ["e"]), ("x", "regular", ["(LOWER(e))"])]
    statements, errors = parse_script("select 1; create table 5; select 2;")
    assert len(statements) == 2 and len(errors) == 1
    assert "union" not in dump(parse("select a from t")) and dump(parse("select a from t")).startswith("select")
    assert quote("order") == "`order`" and quote("a b") == "`a b`" and quote("1") == "`1`" and quote("a1") == "a1"
