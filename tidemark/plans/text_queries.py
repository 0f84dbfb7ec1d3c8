"""Queries over statement texts and log texts made from the driver's tables, with DuckDB SQL where it can tell the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..advice.catalog import Catalog
from ..functions import columns as C
from ..functions.statements import fnv1a_64, with_fingerprints
from ..operators import advise as A
from ..operators.report import Options, cells, ranked_classes
from ..sources.generate import ADMIN_EVERY, SCENARIOS, generate_events, log_text, write_log
from ..sources.scratch import scratch_folder
from ..sources.slowlog import log_counters, read_slow_log, resolved_events, scan_slow_log, stream_slow_log

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def register(function):
        QUERIES[name or function.__name__] = function
        if sql:
            ORACLE[name or function.__name__] = sql
        return function

    return register


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated-event frame whose values come from ``orders``."""
    o, key = _orders(spark, sf_dir), F.col("o_orderkey")
    sql = F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), key.cast("string"), F.lit(" AND o_orderstatus IN ('"), F.col("o_orderstatus"), F.lit("', 'x')"))
    return o.select(
        key.alias("seq"), sql.alias("sql"), F.concat(F.lit("u"), (key % 7).cast("string")).alias("user"), F.concat(F.lit("h"), (key % 3).cast("string")).alias("host"), key.alias("thread_id"),
        F.round(F.col("o_totalprice")).cast("long").alias("query_time_us"), (key % 50).alias("lock_time_us"), (key % 20).alias("rows_sent"), (key % 1000 * 10).alias("rows_examined"),
        (F.lit(1_600_000_000) + key).alias("ts"), F.when(key % 2 == 0, F.lit("s")).otherwise(F.lit("ft")).alias("flags"), (key % 97 == 5).alias("admin"),
    )


def _order_log(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_folder(spark, "orders")
    log_text(_order_events(spark, sf_dir)).repartitionByRange(8, "seq").sortWithinPartitions("seq").select("value").write.text(path)
    return path


@_query("""SELECT o_orderkey AS thread_id, round(o_totalprice)::BIGINT AS query_time_us, o_orderkey % 50 AS lock_time_us, o_orderkey % 20 AS rows_sent, o_orderkey % 1000 * 10 AS rows_examined,
           (o_orderkey % 20) * 72 AS bytes_sent, 1600000000 + o_orderkey AS ts, 'u' || (o_orderkey % 7)::VARCHAR AS user_name, 'h' || (o_orderkey % 3)::VARCHAR AS host,
           o_orderkey % 2 = 0 AND o_orderkey % 1000 > 0 AS full_scan, o_orderkey % 2 = 1 AS filesort, o_orderkey % 2 = 1 AS tmp_table, false AS tmp_disk, 'SELECT' AS kind,
           'select * from orders where o_orderkey = ? and o_orderstatus in(?+)' AS fingerprint
           FROM orders WHERE o_orderkey % 97 <> 5""")
def log_round_trip(spark, sf_dir):
    events = with_fingerprints(read_slow_log(spark, _order_log(spark, sf_dir), split_bytes=1 << 22))
    return events.select("thread_id", "query_time_us", "lock_time_us", "rows_sent", "rows_examined", "bytes_sent", "ts", F.col("user").alias("user_name"), "host", "full_scan", "filesort", "tmp_table", "tmp_disk", "kind", "fingerprint")


@_query("SELECT count(*) FILTER (WHERE o_orderkey % 97 <> 5) AS events, count(*) FILTER (WHERE o_orderkey % 97 = 5) AS skipped FROM orders")
def log_counts(spark, sf_dir):
    return log_counters(spark, _order_log(spark, sf_dir), split_bytes=1 << 16).select("events", "skipped")


@_query("SELECT size, count(*) AS events, sum(round(o_totalprice)::BIGINT)::BIGINT AS query_time_us FROM orders, (VALUES (16384), (100000), (67108864)) s(size) WHERE o_orderkey % 97 <> 5 GROUP BY size")
def chunk_invariance(spark, sf_dir):
    path = _order_log(spark, sf_dir)
    parts = [read_slow_log(spark, path, split_bytes=n).agg(F.lit(n).alias("size"), F.count(F.lit(1)).alias("events"), F.sum("query_time_us").alias("query_time_us")) for n in (16384, 100000, 67108864)]
    return parts[0].union(parts[1]).union(parts[2])


@_query("SELECT count(*) AS calls, sum(round(o_totalprice)::BIGINT)::BIGINT AS query_time_us FROM orders WHERE o_orderkey % 97 <> 5")
def stream_profile(spark, sf_dir):
    """The log as a stream that ends, aggregated in complete mode."""
    events = stream_slow_log(spark, _order_log(spark, sf_dir), split_bytes=1 << 20)
    name = f"stream_{abs(hash(sf_dir)) % 10**8}"
    query = events.agg(F.count(F.lit(1)).alias("calls"), F.sum("query_time_us").alias("query_time_us")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


@_query("""SELECT o_orderkey, 'update orders set o_orderstatus = ?, note = ? where o_orderkey = ? and price > ?' AS fingerprint, 'UPDATE' AS kind FROM orders""")
def fingerprint_template(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    sql = F.concat(F.lit("Update `Orders`  SET o_orderstatus='"), F.col("o_orderstatus"), F.lit("', note = 'it''s "), key, F.lit("' /* c */\nWHERE o_orderkey="), key, F.lit(" AND price > -1.5e3 -- end"))
    return with_fingerprints(_orders(spark, sf_dir).select("o_orderkey", sql.alias("sql"))).select("o_orderkey", "fingerprint", "kind")


@_query("SELECT o_orderkey, 'select a from t where b in(?+)' AS fingerprint FROM orders")
def in_list_collapse(spark, sf_dir):
    items = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 9 + 1).cast("int")), lambda i: i.cast("string")), ",")
    return with_fingerprints(_orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("select a from t where b in ("), items, F.lit(")")).alias("sql"))).select("o_orderkey", "fingerprint")


_KINDS = (("select 1", "SELECT"), ("(select 1)", "SELECT"), ("with c as (select 1) delete from t", "DELETE"), ("insert into t values (1)", "INSERT"), ("replace t values (1)", "REPLACE"), ("call p()", "CALL"), ("truncate t", "DDL"), ("commit", "TRANSACTION"), ("show tables", "UTILITY"), ("nonsense", "UNKNOWN"))


@_query(f"SELECT n_nationkey, [{', '.join(repr(k) for _, k in _KINDS)}][n_nationkey % {len(_KINDS)} + 1] AS kind FROM nation")
def statement_kind(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sql = F.element_at(F.array(*(F.lit(s) for s, _ in _KINDS)), F.col("n_nationkey") % len(_KINDS) + 1)
    return with_fingerprints(nation.select("n_nationkey", sql.alias("sql"))).select("n_nationkey", "kind")


@_query("""SELECT p_partkey, lpad(upper(to_hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(p_name) + 1), lambda i: ascii(substr(p_name, i, 1))::UHUGEINT)),
           lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)), 16, '0') AS class_id FROM part""")
def class_id(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", fnv1a_64(F.col("p_name")).alias("class_id"))


#: For each rule a statement about table {k}, its severity and its title.
RULE_CASES = {
    "st000": ("SELECT FROM WHERE t{k}", "info", "Statement not fully understood: structural checks skipped"),
    "st001": ("SELECT a FROM t{k} WHERE b = 1 AND c > 2", "warning", "t{k} needs an index on (b, c)"),
    "st002": ("DELETE FROM t{k}", "critical", "DELETE without WHERE removes every row of t{k}"),
    "st003": ("SELECT 1 FROM t{k}, u", "critical", "t{k} × u: no join condition (cartesian product)"),
    "st004": ("SELECT a FROM t{k} WHERE YEAR(b) = 2024", "warning", "YEAR(b) hides t{k}.b from its index"),
    "st005": ("SELECT id FROM customers WHERE phone = {k}", "warning", "customers.phone is VARCHAR(20) but is compared to a number"),
    "st006": ("SELECT a FROM t{k} WHERE b LIKE '%x'", "warning", "LIKE '%x' cannot use an index on t{k}.b"),
    "st007": ("SELECT a FROM t{k} WHERE b NOT IN (SELECT c FROM u)", "warning", "NOT IN (SELECT ...) matches nothing if the subquery returns a NULL"),
    "st008": ("SELECT a FROM t{k} LIMIT 5000, 20", "warning", "LIMIT 5000, 20 reads and discards 5,000 rows"),
    "st009": ("SELECT a FROM t{k} ORDER BY RAND() LIMIT 3", "warning", "ORDER BY RAND() sorts every row to return 3"),
    "st010": ("SELECT a FROM t{k} WHERE b = 1 OR c = 2", "info", "OR across b and c"),
    "st011": ("SELECT a FROM t{k} WHERE z IN (" + ", ".join(map(str, range(201))) + ")", "info", "IN list with 201 values"),
    "st012": ("SELECT a FROM t{k} GROUP BY a HAVING a > 1", "info", "HAVING a > 1 filters on a column, not on an aggregate"),
    "st013": ("SELECT * FROM t{k}", "info", "SELECT * reads every column of t{k}"),
}
_DDL = "CREATE TABLE customers (id int PRIMARY KEY, phone varchar(20), KEY k (phone))"


def _rule_query(rule: str, sql: str):
    def run(spark, sf_dir):
        nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.replace(F.lit(sql), F.lit("{k}"), F.col("n_nationkey").cast("string")).alias("sql"))
        catalog = Catalog.from_ddl(_DDL) if rule == "st005" else None
        return A.findings(nation, catalog).where(F.col("rule_id") == rule.upper()).select("n_nationkey", "rule_id", "severity", "title")

    return run


for _rule, (_sql, _severity, _title) in RULE_CASES.items():
    _query(f"SELECT n_nationkey, '{_rule.upper()}' AS rule_id, '{_severity}' AS severity, replace('{_title.replace(chr(39), chr(39) * 2)}', '{{k}}', n_nationkey::VARCHAR) AS title FROM nation", f"advise_{_rule}")(_rule_query(_rule, _sql))


@_query("SELECT n_nationkey, 't' || n_nationkey AS table_name, 'ALTER TABLE t' || n_nationkey || ' ADD INDEX idx_t' || n_nationkey || '_b_c (b, c);' AS ddl FROM nation")
def index_candidates(spark, sf_dir):
    sql = F.concat(F.lit("SELECT a FROM t"), F.col("n_nationkey").cast("string"), F.lit(" WHERE b = 1 ORDER BY c LIMIT 5"))
    return A.index_candidates(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", sql.alias("sql"))).select("n_nationkey", "table_name", "ddl")


@_query("SELECT n_nationkey, 'select\n  items:\n    item\n      expr:\n        column name=a\n  tables:\n    table name=t' || n_nationkey AS tree FROM nation")
def parse_tree(spark, sf_dir):
    sql = F.concat(F.lit("SELECT a FROM t"), F.col("n_nationkey").cast("string"))
    return A.with_trees(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", sql.alias("sql"))).select("n_nationkey", "tree")


@_query("SELECT * FROM (VALUES ('t', 'a', 'int unsigned', 'integer', false), ('t', 'b', 'varchar(10)', 'string', true), ('t', 'c', 'datetime', 'temporal', true)) v(table_name, column_name, type, category, nullable)")
def schema_catalog(spark, sf_dir):
    ddl = "CREATE TABLE t (a int unsigned NOT NULL, b varchar(10)); ALTER TABLE t ADD COLUMN c datetime; CREATE TABLE broken (; ALTER TABLE t ADD INDEX i (b)"
    return A.catalog_table(spark, Catalog.from_ddl(ddl))


@_query("SELECT n_nationkey, 't' || n_nationkey AS table_name, 'ref' AS access_type, 'k' AS key_name, n_nationkey::BIGINT AS rows, 50.0::DOUBLE AS filtered, true AS filesort, false AS temporary, 0 AS ordinal FROM nation")
def explain_flatten(spark, sf_dir):
    key = F.col("n_nationkey").cast("string")
    plan = F.concat(F.lit('{"query_block": {"ordering_operation": {"using_filesort": true, "nested_loop": [{"table": {"table_name": "t'), key, F.lit('", "access_type": "ref", "key": "k", "rows_examined_per_scan": '), key, F.lit(', "filtered": "50.00"}}]}}}'))
    return A.explain_rows(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", plan.alias("plan")))


def _generated(sf_dir: str, spark: SparkSession) -> int:
    """How many events to generate at a scale: one for each order."""
    return _orders(spark, sf_dir).count()


@_query("SELECT count(*) AS events, true AS same_again, true AS weights_kept, true AS medians_kept FROM orders")
def generate_log(spark, sf_dir):
    """Generated events: their number, and whether seed, weights and medians of the scenarios are kept."""
    n = _generated(sf_dir, spark)
    sums = (F.count(F.lit(1)).alias("events"), F.sum(F.xxhash64("sql", "query_time_us", "ts").cast("decimal(20,0)")).alias("sum"), F.median("query_time_us").alias("median"))
    first, again = (generate_events(spark, n, 42, parts).where("not admin").groupBy("scenario").agg(*sums) for parts in (3, 8))
    whole = sum(s[0] for s in SCENARIOS)
    wanted = spark.createDataFrame([(k, s[0] / whole, s[1] * 1000) for k, s in enumerate(SCENARIOS)], "scenario int, weight double, middle double")
    both = first.join(again.select("scenario", F.col("sum").alias("other")), "scenario").join(wanted, "scenario")
    spread = 5 * F.sqrt(F.col("weight") * n) + 5 + F.col("weight") * n / ADMIN_EVERY * 2
    close = (F.abs(F.col("median") / F.col("middle") - 1) < 0.1) | (F.col("events") < 300)
    admin = generate_events(spark, n, 42).where("admin").count()
    return both.agg(
        (F.sum("events") + admin).alias("events"),
        F.bool_and(F.col("sum") == F.col("other")).alias("same_again"),
        F.bool_and(F.abs(F.col("events") - F.col("weight") * n) < spread).alias("weights_kept"),
        F.bool_and(close).alias("medians_kept"),
    )


def _analysed(spark: SparkSession, path: str, split_bytes: int, top: int) -> DataFrame:
    events = resolved_events(scan_slow_log(spark, path, split_bytes, fingerprints=True))
    return ranked_classes(cells(with_fingerprints(events)), events, options=Options(top=top))


@_query("""WITH e AS (
               SELECT o_orderkey AS k, round(o_totalprice)::BIGINT AS t, 'SELECT * FROM orders WHERE o_orderkey = ' || o_orderkey || ' AND o_orderstatus IN (''' || o_orderstatus || ''', ''x'')' AS sql
               FROM orders WHERE o_orderkey % 97 <> 5)
           SELECT 1 AS rank, count(*) AS calls, sum(t)::BIGINT AS total, 1.0::DOUBLE AS share, max(t) AS worst, arg_max(sql, t::HUGEINT * 1000000000 - k) AS worst_sql, 'orders' AS tables, 'ST001,ST014,ST013' AS rules,
                  'ALTER TABLE orders ADD INDEX idx_orders_o_orderkey_o_orderstatus (o_orderkey, o_orderstatus);' AS suggestion FROM e""")
def analyze_orders(spark, sf_dir):
    """From text to advice over the log of all orders: the class, its slowest statement, tables, findings and index."""
    c = _analysed(spark, _order_log(spark, sf_dir), 1 << 18, 5)
    rules = F.array_join(F.transform("findings", lambda f: f["rule_id"]), ",")
    return c.select(
        "rank", "calls", F.col("query_time_us_sum").alias("total"), F.col("time_share").alias("share"), F.col("worst_query_time_us").alias("worst"), "worst_sql", F.array_join("tables", ",").alias("tables"),
        rules.alias("rules"), F.get("findings", F.lit(0))["suggestion"].alias("suggestion"),
    )


@_query()
def analyze_log(spark, sf_dir):
    """From text to advice: a generated log, its costliest classes and their findings."""
    path = scratch_folder(spark, "generated")
    write_log(spark, path, _generated(sf_dir, spark), 42, files=4)
    return _analysed(spark, path, 1 << 22, 20).select("class_id", "rank", F.explode("findings").alias("f")).select("class_id", "rank", "f.*")


@_query(r"""SELECT o_orderkey, lower(o_orderpriority) AS lowered, upper(o_orderpriority) AS raised, trim(' ' || o_orderstatus || chr(9), ' ' || chr(9)) AS trimmed,
           CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS number, lpad(upper(to_hex(o_orderkey)), 16, '0') AS hexed, o_orderkey::VARCHAR AS unhexed,
           strftime(to_timestamp(o_orderkey * 1000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at, format('{:,}', o_orderkey * 1000) AS counted
           FROM orders""")
def scalar_functions(spark, sf_dir):
    key = F.col("o_orderkey")
    return _orders(spark, sf_dir).select(
        "o_orderkey", C.ascii_lower(F.col("o_orderpriority")).alias("lowered"), C.ascii_upper(F.col("o_orderpriority")).alias("raised"), C.trim_blanks(F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit("\t"))).alias("trimmed"),
        C.parse_uint(F.concat(key.cast("string"), F.when(key % 3 == 0, "").otherwise("x"))).alias("number"), C.to_hex(key).alias("hexed"), C.from_hex(C.to_hex(key)).alias("unhexed"), C.format_timestamp(key * 1000).alias("at"), C.format_count(key * 1000).alias("counted"),
    )


@_query("""SELECT n AS id, 'user' || lpad(n::VARCHAR, 6, '0') || '@example.com' AS email, ['BR', 'PT', 'ES', 'MX'][n % 4 + 1] AS country, (n * 7919) % 1000 // 10 AS tier,
           TIMESTAMP '2023-01-01' + (n % 365) * INTERVAL 1 DAY + (n % 1440) * INTERVAL 1 MINUTE AS created_at, sha256('s' || n::VARCHAR) AS token, repeat('ab', (n % 3 + 1)::INTEGER) AS pad,
           CASE WHEN n % 5 = 0 THEN NULL ELSE round(n * 1.25, 1) END AS total FROM range(1, 2001) r(n)""")
def lab_seed(spark, sf_dir):
    """Rows of a seeded shop table: a sequence and the functions that its columns need."""
    n = F.col("id")
    return spark.range(1, 2001).select(
        "id", F.concat(F.lit("user"), F.lpad(n.cast("string"), 6, "0"), F.lit("@example.com")).alias("email"), F.elt((n % 4 + 1).cast("int"), F.lit("BR"), F.lit("PT"), F.lit("ES"), F.lit("MX")).alias("country"), F.expr("(id * 7919) % 1000 div 10").alias("tier"),
        F.expr("timestamp_ntz'2023-01-01' + make_dt_interval(cast(id % 365 as int), 0, cast(id % 1440 as int))").alias("created_at"), F.sha2(F.concat(F.lit("s"), n.cast("string")), 256).alias("token"), F.expr("repeat('ab', cast(id % 3 + 1 as int))").alias("pad"),
        F.when(n % 5 == 0, F.lit(None)).otherwise(F.round(n.cast("decimal(10,0)") * F.lit("1.25").cast("decimal(3,2)"), 1)).cast("double").alias("total"),
    )


@_query("SELECT 'ALTER TABLE t' || (n_nationkey % 5) || ' ADD INDEX idx_t' || (n_nationkey % 5) || '_b (b);' AS statement, min(n_nationkey) AS first FROM nation GROUP BY n_nationkey % 5")
def index_statements(spark, sf_dir):
    sql = F.concat(F.lit("SELECT * FROM t"), (F.col("n_nationkey") % 5).cast("string"), F.lit(" WHERE b = 1"))
    found = A.findings(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", sql.alias("sql")))
    return A.index_statements(found.drop("ordinal").withColumnRenamed("n_nationkey", "ordinal"))
