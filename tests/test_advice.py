"""Catalog, facts, index candidates and rules."""

import pytest

from tidemark.advice.catalog import Catalog, category_of
from tidemark.advice.facts import collect_facts
from tidemark.advice.indexes import index_name, suggest
from tidemark.advice.rules import Engine, Finding, Rule, Stats
from tidemark.sql.parser import parse

DDL = """
CREATE TABLE customers (id int unsigned NOT NULL, email varchar(190) NOT NULL, phone varchar(20), country char(2), PRIMARY KEY (id), UNIQUE KEY uq (email));
CREATE TABLE orders (id bigint unsigned NOT NULL, customer_id int unsigned, status enum('a','b'), total decimal(12,2), created_at datetime, note text, PRIMARY KEY (id), KEY idx_orders_customer (customer_id));
CREATE TABLE order_items (id bigint, order_id bigint, product_id int, code varchar(8), PRIMARY KEY (id));
"""


@pytest.fixture(scope="module")
def catalog():
    return Catalog.from_ddl(DDL)


def found(sql, catalog=None, stats=None, **options):
    return [(f.rule_id, f.severity, f.title) for f in Engine(**options).advise(sql, catalog, stats)]


def test_categories():
    want = {"INT(11) unsigned": "integer", "year": "integer", "bit": "integer", "decimal(3,1)": "decimal", "double": "float", "enum('a')": "string", "longtext": "string", "varbinary(3)": "binary", "datetime": "temporal", "json": "json", "geometry": "other"}
    assert {t: category_of(t) for t in want} == want


def test_catalog_replay(catalog):
    more = Catalog.from_ddl(DDL + "ALTER TABLE Orders ADD COLUMN x int, DROP INDEX idx_orders_customer, ADD KEY y (x, status); CREATE UNIQUE INDEX z ON orders (total); CREATE TABLE 5;")
    orders = more.table("ORDERS")
    assert orders.column("X").type == "int" and list(orders.indexes) == ["primary", "y", "z"]
    assert len(more.warnings) == 1 and [t.name for t in more.tables_with_column("order_id")] == ["order_items"]
    index = orders.indexes["y"]
    assert index.serves(["x"], ["status"]) and index.serves(["STATUS", "x"], []) and not index.serves(["status"], [])


def test_facts():
    f = collect_facts(parse("SELECT COUNT(*) FROM orders o JOIN customers c ON c.id = o.customer_id WHERE o.status = 'a' AND NOT (c.email LIKE 'x%' OR o.total + 1 > 5) ORDER BY o.created_at LIMIT 10, 5"))
    assert [(p.kind, str(p.column), p.negated, p.under_or, p.wrapper) for p in f.predicates] == [("equality", "orders.status", False, False, ""), ("like", "customers.email", True, True, ""), ("range", "orders.total", True, True, "arithmetic"), ("equality", "customers.id", False, False, "")]
    assert (f.links, f.limit, f.offset, f.has_aggregate) == ([("c", "o")], 5, 10, True)


def test_index_candidates(catalog):
    one = lambda sql, c=None: [x.ddl for x in suggest(collect_facts(parse(sql), c), c)]
    assert one("SELECT * FROM orders WHERE customer_id = 1 AND status = 'a' ORDER BY created_at DESC LIMIT 5", catalog) == ["ALTER TABLE orders ADD INDEX idx_orders_customer_id_status_created_at (customer_id, status, created_at);"]
    assert one("SELECT 1 FROM t WHERE id = 5") == [] and one("SELECT 1 FROM orders WHERE customer_id = 5", catalog) == []
    assert one("SELECT 1 FROM mysql.t WHERE a = 5") == [] and one("SELECT 1 FROM t WHERE a = 1 OR b = 2") == []
    assert one("SELECT 1 FROM t WHERE a > 1 AND b < 2 AND c IN (1, 2)") == ["ALTER TABLE t ADD INDEX idx_t_c_a (c, a);"]
    assert one("SELECT a FROM t GROUP BY a, b") == ["ALTER TABLE t ADD INDEX idx_t_a_b (a, b);"]
    assert len(index_name("t" * 60, ["column"])) == 64


RULE_CASES = [
    ("SELECT a FROM t WHERE b = 1", ("ST001", "warning", "t needs an index on (b)")),
    ("UPDATE t SET a = 1", ("ST002", "critical", "UPDATE without WHERE rewrites every row of t")),
    ("DELETE FROM t LIMIT 1000", ("ST002", "warning", "DELETE without WHERE removes an arbitrary 1,000 rows of t")),
    ("SELECT 1 FROM customers, orders", ("ST003", "critical", "customers × orders: no join condition (cartesian product)")),
    ("SELECT id FROM customers WHERE LOWER(email) = 'x'", ("ST004", "warning", "LOWER(email) hides customers.email from its index")),
    ("SELECT id FROM customers WHERE phone = 5", ("ST005", "warning", "customers.phone is VARCHAR(20) but is compared to a number")),
    ("SELECT 1 FROM orders o JOIN order_items i ON i.code = o.id", ("ST005", "warning", "order_items.code (VARCHAR(8)) is joined to orders.id (BIGINT UNSIGNED)")),
    ("SELECT id FROM t WHERE a LIKE '_x'", ("ST006", "warning", "LIKE '_x' cannot use an index on t.a")),
    ("SELECT id FROM t WHERE NOT a IN (SELECT b FROM u)", ("ST007", "warning", "NOT IN (SELECT ...) matches nothing if the subquery returns a NULL")),
    ("SELECT id FROM t LIMIT 1000, 10", ("ST008", "warning", "LIMIT 1000, 10 reads and discards 1,000 rows")),
    ("SELECT id FROM t ORDER BY RAND()", ("ST009", "warning", "ORDER BY RAND() sorts every row to return a few")),
    ("SELECT id FROM customers WHERE phone = '1' OR email = 'x'", ("ST010", "warning", "OR across phone and email")),
    ("SELECT id FROM t WHERE a IN (" + "1, " * 200 + "1)", ("ST011", "info", "IN list with 201 values")),
    ("SELECT a FROM t GROUP BY a HAVING a = 1", ("ST012", "info", "HAVING a = 1 filters on a column, not on an aggregate")),
    ("SELECT o.* FROM orders o JOIN customers c ON c.id = o.customer_id", ("ST013", "info", "SELECT * reads every column of orders")),
    ("SELECT FROM WHERE", ("ST000", "info", "Statement not fully understood: structural checks skipped")),
]


@pytest.mark.parametrize(("sql", "finding"), RULE_CASES)
def test_rule_fires(sql, finding, catalog):
    assert finding in found(sql, catalog)


@pytest.mark.parametrize(("rule", "sql"), [
    ("ST001", "SELECT id FROM orders WHERE customer_id = 1"), ("ST002", "DELETE FROM t WHERE a = 1"), ("ST003", "SELECT 1 FROM a JOIN b ON a.x = b.x"), ("ST003", "SELECT 1 FROM a, b WHERE x = y"),
    ("ST004", "SELECT 1 FROM t WHERE a = LOWER('x')"), ("ST004", "SELECT 1 FROM t WHERE MATCH(a) AGAINST('x') > 0"), ("ST005", "SELECT id FROM customers WHERE phone = '5'"), ("ST006", "SELECT 1 FROM t WHERE a LIKE 'x%'"),
    ("ST007", "SELECT 1 FROM t WHERE a IN (SELECT 1)"), ("ST008", "SELECT 1 FROM t LIMIT 999, 5"), ("ST008", "SELECT 1 FROM t LIMIT ?, 5"), ("ST010", "SELECT 1 FROM t WHERE a = 1 OR a = 2"), ("ST012", "SELECT a FROM t GROUP BY a HAVING COUNT(*) > 1"),
    ("ST013", "SELECT COUNT(*) FROM t"), ("ST013", "SELECT * FROM (SELECT 1) d"), ("ST000", "nonsense"),
])
def test_rule_stays_quiet(rule, sql, catalog):
    assert rule not in {f[0] for f in found(sql, catalog)}


def test_metric_rules_and_severity():
    stats = Stats("SELECT", 10, rows_examined=480_000, rows_sent=3, tmp_disk=1.0)
    got = found("SELECT a FROM t WHERE b = 1", None, stats)
    assert ("ST014", "critical", "Examines 480k rows to return 3 (160k:1)") in got and ("ST015", "warning", "Temporary tables spill to disk in 100% of executions") in got
    assert ("ST001", "critical", "t needs an index on (b)") in got
    assert [f[1] for f in got] == sorted((f[1] for f in got), key=["critical", "warning", "info"].index)
    assert found("(((", None, Stats("UPDATE", 2, rows_examined=2000, rows_affected=0)) == [("ST014", "warning", "Examines 2.0k rows per execution")]


def test_disabling_and_own_rules():
    assert found("SELECT * FROM t", disabled=("select-star",)) == [] and found("SELECT FROM", disabled=("ST000",)) == []
    with pytest.raises(ValueError, match="unknown rule"):
        Engine(("nope",))
    own = Rule("X1", "own", "info", "", lambda c: iter([("info", "seen", "", "")]))
    assert Finding("X1", "own", "info", "seen", "", "") in Engine(extra=(own,)).advise("SELECT 1")
