"""Queries over statements of many shapes, with names and values from the driver's tables.

A row's key picks the shape of its statement and fills its marks: ``{k}`` is the key, ``{d}`` its last digit.  The SQL
states the results that each shape must have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..advice.catalog import Catalog
from ..advice.rules import Engine
from ..operators import advise as A

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE[function.__name__] = sql
        return function

    return register


def _filled(text: Column, key: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{k}"), key.cast("string")), F.lit("{d}"), (key % 10).cast("string"))


def _shaped(spark: SparkSession, sf_dir: str, shapes: list[str], table: str = "customer", key: str = "c_custkey") -> DataFrame:
    """``id, sql``: a statement for every row of a table."""
    number = F.col(key)
    shape = F.element_at(F.array(*(F.lit(s) for s in shapes)), (number % len(shapes) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(number.alias("id"), _filled(shape, number).alias("sql"))


def _expected(columns: dict[str, list[list[str]]], table: str = "customer", key: str = "c_custkey") -> str:
    """SQL that lists, for every row of a table, the rows that its shape must give: per shape a list of values per column."""
    names = list(columns)
    shapes = len(columns[names[0]])
    struct = lambda k: "[" + ", ".join("{" + ", ".join(f"{quoted(n)}: {quoted(columns[n][k][j])}" for n in names) + "}" for j in range(len(columns[names[0]][k]))) + "]"
    kind = "STRUCT(" + ", ".join(f'"{n}" VARCHAR' for n in names) + ")[]"
    listed = ", ".join(f"{struct(k)}::{kind}" for k in range(shapes))
    fill = lambda n: f"replace(replace(r.{n}, '{{k}}', id::VARCHAR), '{{d}}', (id % 10)::VARCHAR) AS {n}"
    return f"SELECT id, {', '.join(map(fill, names))} FROM (SELECT {key} AS id, unnest([{listed}][{key} % {shapes} + 1]) AS r FROM {table})"


#: Statements, and how the writer spells them (empty: an error, whose text is the second part).
SPELLINGS = [
    ("SELECT a FROM t{k} WHERE b BETWEEN 1 AND {k} AND c NOT BETWEEN 'x' AND 'y'", "SELECT a FROM t{k} WHERE b BETWEEN 1 AND {k} AND c NOT BETWEEN 'x' AND 'y'"),
    ("select distinct a.*, count( * ) n from t{k} a where a.b is not null and a.c is null or not a.d is true", "SELECT DISTINCT a.*, COUNT(*) AS n FROM t{k} AS a WHERE a.b IS NOT NULL AND a.c IS NULL OR NOT a.d IS TRUE"),
    ("select a from t{k} where (a,b) in ((1,2),(3,{k})) and c not in (1)", "SELECT a FROM t{k} WHERE (a, b) IN ((1, 2), (3, {k})) AND c NOT IN (1)"),
    ("select a from t{k} where b = any (select c from u) and d <> all (select 1) and not exists (select 2)", "SELECT a FROM t{k} WHERE b = ANY (SELECT c FROM u) AND d <> ALL (SELECT 1) AND NOT EXISTS (SELECT 2)"),
    ("select a from t{k} where a like '%x' and b not like 'y_' and c regexp '^z'", "SELECT a FROM t{k} WHERE a LIKE '%x' AND b NOT LIKE 'y_' AND c REGEXP '^z'"),
    ("select a from t{k} x left outer join u y on x.i=y.i right join v using (j) cross join w", "SELECT a FROM t{k} AS x LEFT JOIN u AS y ON x.i = y.i RIGHT JOIN v USING (j) CROSS JOIN w"),
    ("select a from t{k} natural join u straight_join v on v.i = u.i", "SELECT a FROM t{k} NATURAL JOIN u STRAIGHT_JOIN v ON v.i = u.i"),
    ("select a, sum(b) s from t{k} group by a with rollup having sum(b) > {k} order by s desc, 1 limit 5, 10", "SELECT a, SUM(b) AS s FROM t{k} GROUP BY a WITH ROLLUP HAVING SUM(b) > {k} ORDER BY s DESC, 1 LIMIT 5, 10"),
    ("(select a from t{k}) union all select b from u union select 3 order by 1 limit 2", "SELECT a FROM t{k} UNION ALL SELECT b FROM u UNION SELECT 3 ORDER BY 1 LIMIT 2"),
    ("select a from t{k} except select b from u intersect select c from v", "SELECT a FROM t{k} EXCEPT SELECT b FROM u INTERSECT SELECT c FROM v"),
    ("select a from t{k} partition (p0) use index (i1, i2) ignore index for order by (i3) where a = 1", "SELECT a FROM t{k} WHERE a = 1"),
    ("select a from t{k} force index for join (primary) where a = 1", "SELECT a FROM t{k} WHERE a = 1"),
    ("select 1 + 2 * 3 - 4 / 5 % 6, (1 + 2) * {k}, -a ^ 2, a | b & c << 1, not a = b and c or d xor e", "SELECT 1 + 2 * 3 - 4 / 5 % 6, (1 + 2) * {k}, -a ^ 2, a | b & c << 1, NOT a = b AND c OR d XOR e"),
    ("select ((a or b) and c) xor (not (d = 1)), (a - (b - {k})) * ((c)), (a, (b)) = (1, (2))", "SELECT (a OR b) AND c XOR NOT d = 1, (a - (b - {k})) * c, (a, b) = (1, 2)"),
    ("select `a b`, `select`, `x`.`y-z`, `plain`, `{k}` from `t{k}` as `order`", "SELECT `a b`, `select`, x.`y-z`, plain, `{k}` FROM t{k} AS `order`"),
    ("select case when a > {k} then 'x' when a < 0 then 'y' else null end, case b when 1 then 2 end from t{k}", "SELECT CASE WHEN a > {k} THEN 'x' WHEN a < 0 THEN 'y' ELSE NULL END, CASE b WHEN 1 THEN 2 END FROM t{k}"),
    ("select cast(a as unsigned), convert(b using utf8mb4), extract(year from c), d + interval {k} day from t{k}", "SELECT CAST(a AS UNSIGNED), CONVERT(b USING utf8mb4), EXTRACT(YEAR FROM c), d + INTERVAL {k} DAY FROM t{k}"),
    ("select match(a, b) against ('x y'), j->'$.a', j->>'$.b' from t{k}", "SELECT MATCH(a, b) AGAINST('x y'), j->'$.a', j->>'$.b' FROM t{k}"),
    ("with recursive c (n) as (select 1 union all select n + 1 from c where n < {k}) select n from c", "WITH c (n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < {k}) SELECT n FROM c"),
    ("select a div 2, a mod 3, a <=> b, binary c, !e, ~f from t{k}", "SELECT a DIV 2, a % 3, a <=> b, BINARY c, NOT e, ~f FROM t{k}"),
    ("select a from (select b as a from t{k}) d, (select 1) e where d.a in (select 9)", "SELECT a FROM (SELECT b AS a FROM t{k}) AS d, (SELECT 1) AS e WHERE d.a IN (SELECT 9)"),
]


@_query(_expected({"canonical": [[c] for _, c in SPELLINGS]}))
def sql_spelling(spark, sf_dir):
    return A.with_canonical(_shaped(spark, sf_dir, [s for s, _ in SPELLINGS])).select("id", "canonical")


#: Statements that do not parse, with the message.
ERRORS = [
    ("SELECT a FROM t WHERE", "expected an expression but found end of statement at offset 21"),
    ("SELECT (1", "expected ')' but found end of statement at offset 9"),
    ("SELECT a b c", "expected end of statement but found 'c' at offset 11"),
]


@_query(_expected({"error": [[e] for _, e in ERRORS]}, "supplier", "s_suppkey"))
def parse_errors(spark, sf_dir):
    return A.with_canonical(_shaped(spark, sf_dir, [s for s, _ in ERRORS], "supplier", "s_suppkey")).where("canonical is null").select("id", "error")


_SCHEMA = """
CREATE TABLE parcels (parcel_no BIGINT UNSIGNED NOT NULL, depot_id INT, state VARCHAR(12), weight_g INT, left_at DATETIME, note VARCHAR(80), PRIMARY KEY (parcel_no), KEY by_depot (depot_id), KEY by_note (note));
CREATE TABLE couriers (courier_id INT NOT NULL, mobile VARCHAR(20), licence VARCHAR(30), PRIMARY KEY (courier_id), UNIQUE KEY by_mobile (mobile));
CREATE TABLE scans (parcel_no BIGINT UNSIGNED, courier_id INT, place VARCHAR(20), KEY by_parcel (parcel_no, place));
"""
#: Statements, and (rule, severity, title, first line of the suggestion where it is a statement or a value) of each finding.
ADVICE: list[tuple[str, list[tuple[str, str, str, str]]]] = [
    ("SELECT note FROM parcels WHERE depot_id = {k} AND state = 'held' ORDER BY left_at LIMIT 5", [("ST001", "warning", "parcels needs an index on (depot_id, state, left_at)", "ALTER TABLE parcels ADD INDEX idx_parcels_depot_id_state_left_at (depot_id, state, left_at);\nThen drop the index it makes redundant: ALTER TABLE parcels DROP INDEX by_depot;")]),
    ("SELECT note FROM parcels WHERE depot_id = {k} ORDER BY weight_g", [("ST001", "warning", "parcels needs an index on (depot_id, weight_g)", "ALTER TABLE parcels ADD INDEX idx_parcels_depot_id_weight_g (depot_id, weight_g);\nThen drop the index it makes redundant: ALTER TABLE parcels DROP INDEX by_depot;")]),
    ("SELECT state, COUNT(*) FROM parcels WHERE weight_g > {k} GROUP BY state", [("ST001", "warning", "parcels needs an index on (weight_g)", "ALTER TABLE parcels ADD INDEX idx_parcels_weight_g (weight_g);")]),
    ("SELECT place FROM scans WHERE parcel_no = {k}", []),
    ("SELECT place FROM scans WHERE courier_id = {k} AND place LIKE 'g%'", [("ST001", "warning", "scans needs an index on (courier_id, place)", "ALTER TABLE scans ADD INDEX idx_scans_courier_id_place (courier_id, place);")]),
    ("SELECT parcel_no FROM parcels WHERE DATE(left_at) = '2024-03-1{d}'", [("ST004", "warning", "DATE(left_at) hides parcels.left_at from its index", "left_at >= '2024-03-1{d}' AND left_at < '2024-03-1{d}' + INTERVAL 1 DAY")]),
    ("SELECT parcel_no FROM parcels WHERE YEAR(left_at) = 2016", [("ST004", "warning", "YEAR(left_at) hides parcels.left_at from its index", "left_at >= '2016-01-01' AND left_at < '2017-01-01'")]),
    ("SELECT parcel_no FROM parcels WHERE weight_g + {k} > 5", [("ST004", "warning", "weight_g + {k} hides parcels.weight_g from its index", "")]),
    ("SELECT licence FROM couriers WHERE mobile = {k}", [("ST005", "warning", "couriers.mobile is VARCHAR(20) but is compared to a number", "mobile = '{k}'")]),
    ("SELECT licence FROM couriers WHERE courier_id NOT IN (SELECT courier_id FROM scans WHERE place = 'p{k}')", [("ST007", "warning", "NOT IN (SELECT ...) matches nothing if the subquery returns a NULL", "NOT EXISTS (SELECT 1 FROM scans WHERE scans.courier_id = couriers.courier_id)")]),
    ("SELECT c.licence FROM couriers c, scans s WHERE c.mobile = 'm{k}'", [("ST003", "critical", "couriers × scans: no join condition (cartesian product)", "")]),
    ("DELETE FROM scans LIMIT 7{d}", [("ST002", "warning", "DELETE without WHERE removes an arbitrary 7{d} rows of scans", "")]),
    ("SELECT note FROM parcels ORDER BY RAND() LIMIT {k}{d}", [("ST009", "warning", "ORDER BY RAND() sorts every row to return ", "")]),
    ("SELECT note FROM parcels WHERE state = 'a{k}' OR weight_g = {k}", [("ST010", "warning", "OR across state and weight_g", "SELECT ... WHERE state = ? UNION SELECT ... WHERE weight_g = ?")]),
    ("SELECT * FROM parcels LIMIT 20{d}0, 10", [("ST008", "warning", "LIMIT 20{d}0, 10 reads and discards 2,0{d}0 rows", ""), ("ST013", "info", "SELECT * reads every column of parcels", "")]),
    ("SELECT state FROM parcels GROUP BY state HAVING state > 'a{k}'", [("ST001", "warning", "parcels needs an index on (state)", "ALTER TABLE parcels ADD INDEX idx_parcels_state (state);"), ("ST012", "info", "HAVING state > 'a{k}' filters on a column, not on an aggregate", "... WHERE state > 'a{k}' GROUP BY ...")]),
    ("SELECT note FROM parcels WHERE note LIKE '%{k}'", [("ST006", "warning", "LIKE '%{k}' cannot use an index on parcels.note", "")]),
    ("SELECT 1 FROM information_schema.tables WHERE table_name = 't{k}'", []),
]
#: What a suggestion says in so many words: index statements, rewritten conditions, quoted values.
_FIXED = r"(ALTER TABLE [\s\S]*;|NOT EXISTS \(.*\)|\.\.\. WHERE .* GROUP BY \.\.\.|SELECT \.\.\. WHERE .* UNION .*|\w+ >= '.*(?='\z|\.\z)'?|\w+ >= .* DAY|mobile = '\d+')"


def _suggested(found: DataFrame) -> DataFrame:
    title = F.when(F.col("rule_id") == "ST009", F.regexp_replace("title", r"\d[\d,]*\z", "")).otherwise(F.col("title"))
    return found.select("id", F.col("ordinal").cast("string").alias("ordinal"), "rule_id", "severity", title.alias("title"), F.when(F.col("rule_id") == "ST009", "").otherwise(F.regexp_extract("suggestion", _FIXED, 1)).alias("fixed"))


def _advice_columns(wanted) -> dict[str, list[list[str]]]:
    kept = [[f for f in found if wanted(f)] for _, found in ADVICE]
    return {"ordinal": [[str(k) for k in range(len(found))] for found in kept]} | {n: [[f[k] for f in found] for found in kept] for k, n in enumerate(("rule_id", "severity", "title", "fixed"))}


@_query(_expected(_advice_columns(lambda f: True), "part", "p_partkey"))
def advise_details(spark, sf_dir):
    """Findings against a schema, with the statements and values that they suggest."""
    return _suggested(A.findings(_shaped(spark, sf_dir, [s for s, _ in ADVICE], "part", "p_partkey"), Catalog.from_ddl(_SCHEMA)))


@_query(_expected(_advice_columns(lambda f: f[1] != "info" and f[0] not in ("ST001", "ST006")), "part", "p_partkey"))
def advise_selected(spark, sf_dir):
    """The same with two rules switched off, one by id and one by name, and without the lowest severity."""
    statements = _shaped(spark, sf_dir, [s for s, _ in ADVICE], "part", "p_partkey")
    return _suggested(A.findings(statements, Catalog.from_ddl(_SCHEMA), Engine(("ST001", "leading-wildcard")), min_severity="warning"))


#: Statements, and (kind, column, negated, under OR, wrapper) of the conditions that facts list, and the base tables.
CONDITIONS = [
    ("SELECT 1 FROM t{k} a WHERE a.x = 1 AND NOT (a.y > 2 OR a.z LIKE 'q%') AND a.w IN (1, 2)", [("equality", "t{k}.x", "false", "false", ""), ("range", "t{k}.y", "true", "true", ""), ("like", "t{k}.z", "true", "true", ""), ("in", "t{k}.w", "false", "false", "")], "t{k}"),
    ("SELECT 1 FROM t{k} WHERE YEAR(d) = {k} AND e LIKE 'x%' AND f + 1 < 3", [("equality", "t{k}.d", "false", "false", "year"), ("like", "t{k}.e", "false", "false", ""), ("range", "t{k}.f", "false", "false", "arithmetic")], "t{k}"),
    ("SELECT 1 FROM t{k} a JOIN u b ON a.i = b.i AND b.s = 'x' LEFT JOIN t{k} c ON c.j = b.j WHERE a.n BETWEEN 1 AND 2", [("range", "t{k}.n", "false", "false", ""), ("equality", "t{k}.i", "false", "false", ""), ("equality", "u.s", "false", "false", ""), ("equality", "t{k}.j", "false", "false", "")], "t{k},u"),
    ("UPDATE t{k} SET a = 1 WHERE b <> 2 AND c IS NULL", [("inequality", "t{k}.b", "false", "false", ""), ("is_null", "t{k}.c", "false", "false", "")], "t{k}"),
    ("DELETE FROM s.t{k} WHERE b = 5 LIMIT 3", [("equality", "t{k}.b", "false", "false", "")], "t{k}"),
]


@_query(_expected({n: [[p[k] for p in found] for _, found, _ in CONDITIONS] for k, n in enumerate(("kind", "column_name", "negated", "under_or", "wrapper"))}, "supplier", "s_suppkey"))
def statement_conditions(spark, sf_dir):
    found = A.predicates(_shaped(spark, sf_dir, [s for s, _, _ in CONDITIONS], "supplier", "s_suppkey"))
    return found.select("id", "kind", "column_name", F.col("negated").cast("string").alias("negated"), F.col("under_or").cast("string").alias("under_or"), "wrapper")


@_query(_expected({"tables": [[t] for _, _, t in CONDITIONS]}, "supplier", "s_suppkey"))
def class_tables(spark, sf_dir):
    return A.with_tables(_shaped(spark, sf_dir, [s for s, _, _ in CONDITIONS], "supplier", "s_suppkey")).select("id", F.array_join("tables", ",").alias("tables"))
