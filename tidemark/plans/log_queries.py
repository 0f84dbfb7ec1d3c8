"""Queries over logs of several servers' dialects, written from the driver's ``orders`` and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.statements import with_fingerprints
from ..operators import profile as P
from ..sources.scratch import scratch_folder
from ..sources.slowlog import filesystem, read_log_text, read_slow_log, stream_slow_log

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE[function.__name__] = sql
        return function

    return register


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _dialect_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, value``: an event per order, by turns as MySQL 8, Percona Server and MariaDB write it.

    Some orders come after a server's banner, some begin with a ``use`` or carry a schema of their own, some are
    administrator commands.
    """
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    at = F.lit(1_700_000_000) + k
    zone = F.element_at(F.array(F.lit("Z"), F.lit("+02:00"), F.lit("-03:30")), (k % 5 % 3 + 1).cast("int"))
    away = F.element_at(F.array(F.lit(0), F.lit(7200), F.lit(-12600)), (k % 5 % 3 + 1).cast("int"))
    written = lambda shift, form: F.date_format(F.timestamp_add("SECOND", at + shift, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), form)
    seconds = F.format_string("%d.%06d", F.floor(k % 7).cast("long"), (k * 37 % 1_000_000).cast("long"))
    banner = F.when(k % 61 == 0, F.lit("/bin/mysqld, Version: 8.0.1. started with:\nTcp port: 1  Unix socket: x\nTime                 Id Command    Argument\n")).otherwise("")
    use = F.when(k % 41 == 3, _text("use db", k % 5, ";\n")).otherwise("")
    body = F.when(k % 97 == 5, "# administrator command: Ping;").otherwise(_text("SELECT ", k, "\n# not a header\nFROM orders;"))
    mysql = _text(
        "# Time: ", written(away, "yyyy-MM-dd'T'HH:mm:ss"), ".25", zone, "\n# User@Host: app[app] @ host", k % 3, " [10.0.0.1]  Id: ", k, "\n# Query_time: ", seconds,
        "  Lock_time: 0.000002 Rows_sent: ", k % 11, "  Rows_examined: ", k % 1000, " Thread_id: ", k, " Bytes_sent: ", k % 500, " Read_rnd_next: ", k % 2, " Sort_scan_count: ", k % 3, " Created_tmp_disk_tables: 0 Created_tmp_tables: 1\n",
        use, "SET timestamp=", at, ";\n", body,
    )
    percona = _text(
        "# Time: ", written(F.lit(0), "yyMMdd HH:mm:ss"), "\n# User@Host: app[app] @ [10.0.0.", k % 3, "]  Id: ", k, "\n# Schema: ", F.when(k % 13 == 1, "own").otherwise(""), "  Last_errno: 0  Killed: 0\n# Query_time: ", seconds,
        "  Lock_time: 0.000002  Rows_sent: ", k % 11, "  Rows_examined: ", k % 1000, "  Rows_affected: ", k % 4, "\n# Bytes_sent: ", k % 500, "  Tmp_tables: 1\n# Full_scan: ", F.when(k % 2 == 1, "Yes").otherwise("No"), "  Filesort: ",
        F.when(k % 3 > 0, "Yes").otherwise("No"), "  Tmp_table: Yes  Tmp_table_on_disk: No\n", use, body,
    )
    maria = _text(
        "# Time: ", written(F.lit(0), "yyMMdd HH:mm:ss"), "\n# User@Host: app[app] @ host", k % 3, " []\n# Thread_id: ", k, "  Schema: ", F.when(k % 13 == 1, "own").otherwise(""), "  QC_hit: No\n# Query_time: ", seconds,
        "  Lock_time: 0.000002  Rows_sent: ", k % 11, "  Rows_examined: ", k % 1000, "\n# Rows_affected: ", k % 4, "  Bytes_sent: ", k % 500, "\n# Full_scan: ", F.when(k % 2 == 1, "Yes").otherwise("No"), "  Filesort: ",
        F.when(k % 3 > 0, "Yes").otherwise("No"), "  Tmp_table: Yes\n", use, "SET timestamp=", at, ";\n", body,
    )
    return o.select(k.alias("seq"), F.concat(banner, F.when(k % 3 == 0, mysql).when(k % 3 == 1, percona).otherwise(maria)).alias("value"))


def _dialect_log(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_folder(spark, "dialects")
    _dialect_lines(spark, sf_dir).repartitionByRange(1, "seq").sortWithinPartitions("seq").select("value").write.text(path)
    return path


#: The events as the rows of ``orders`` define them; ``carried`` is the database of the last ``use`` before or in an event.
_EVENTS = """
    e AS (
        SELECT k, 'SELECT ' || k || chr(10) || '# not a header' || chr(10) || 'FROM orders' AS sql, 'app' AS user_name,
               CASE k % 3 WHEN 1 THEN '10.0.0.' || (k % 3) ELSE 'host' || (k % 3) END AS host,
               (k % 7) * 1000000 + k * 37 % 1000000 AS query_time_us, 2 AS lock_time_us, k % 11 AS rows_sent, k % 1000 AS rows_examined,
               CASE WHEN k % 3 = 0 THEN 0 ELSE k % 4 END AS rows_affected, k % 500 AS bytes_sent, k AS thread_id, 1700000000 + k AS ts,
               k % 2 = 1 AS full_scan, k % 3 > 0 AS filesort, true AS tmp_table, false AS tmp_disk,
               CASE WHEN k % 13 = 1 AND k % 3 > 0 THEN 'own'
                    ELSE coalesce(last_value(CASE WHEN k % 41 = 3 THEN 'db' || (k % 5) END IGNORE NULLS) OVER (ORDER BY k), '') END AS database
        FROM (SELECT o_orderkey AS k FROM orders) QUALIFY true),
    ev AS (SELECT * FROM e WHERE k % 97 <> 5)
"""


@_query(f"WITH {_EVENTS} SELECT thread_id, user_name, host, query_time_us, lock_time_us, rows_sent, rows_examined, rows_affected, bytes_sent, ts, full_scan, filesort, tmp_table, tmp_disk, sql FROM ev")
def log_dialects(spark, sf_dir):
    events = read_slow_log(spark, _dialect_log(spark, sf_dir), split_bytes=1 << 17)
    names = ("thread_id", "host", "query_time_us", "lock_time_us", "rows_sent", "rows_examined", "rows_affected", "bytes_sent", "ts", "full_scan", "filesort", "tmp_table", "tmp_disk", "sql")
    return events.select(F.col("user").alias("user_name"), *names)


@_query(f"WITH {_EVENTS} SELECT thread_id, database FROM ev")
def database_carry(spark, sf_dir):
    """The database in force, carried over ranges that are small beside the way from one ``use`` to the next."""
    return read_slow_log(spark, _dialect_log(spark, sf_dir), split_bytes=1 << 14).select("thread_id", "database")


@_query(f"WITH {_EVENTS} SELECT thread_id, database, query_time_us FROM ev WHERE thread_id <= 2000")
def log_in_memory(spark, sf_dir):
    """A part of the log as one text in the driver's memory."""
    lines = _dialect_lines(spark, sf_dir).where("seq <= 2000").orderBy("seq").select("value").toPandas()["value"]
    return read_log_text(spark, "\n".join([*lines, ""])).select("thread_id", "database", "query_time_us")


@_query(f"WITH {_EVENTS} SELECT thread_id, database, query_time_us FROM ev WHERE thread_id <= 1500")
def growing_log(spark, sf_dir):
    """A log that grows between the batches of a stream, each time in the middle of an event, and is rotated once."""
    lines = _dialect_lines(spark, sf_dir).where("seq <= 1500").orderBy("seq").select("value").toPandas()["value"]
    text = "\n".join([*lines, ""]).encode()
    turn = text.rindex(b"# Time: ", 0, text.index(b"\nuse db", len(text) // 2))  # a log names its databases anew
    folder, found, state = (scratch_folder(spark, name) for name in ("growing", "found", "state"))
    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)

    def write(name: str, data: bytes) -> None:
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(data)

    def step() -> None:
        query = stream_slow_log(spark, folder, split_bytes=1 << 14).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(found)
        query.awaitTermination()

    for size in (len(text) // 5, len(text) // 3, turn):
        write("slow.log", text[:size])
        step()
    system.move(f"{base}/slow.log", f"{base}/slow.log.1")
    write("slow.log", text[turn:])
    step()
    return spark.read.parquet(found).select("thread_id", "database", "query_time_us")


@_query(f"""WITH {_EVENTS} SELECT database, count(*) AS calls, sum(bytes_sent)::BIGINT AS bytes_sent, sum(rows_affected)::BIGINT AS rows_affected_sum, max(rows_affected) AS rows_affected_max,
            sum(lock_time_us)::BIGINT AS lock_time_us_sum, count(*) FILTER (WHERE filesort) AS filesort_count, count(*) FILTER (WHERE tmp_table) AS tmp_table_count, min(ts) AS first_seen FROM ev GROUP BY database""")
def log_profile(spark, sf_dir):
    """Classes by database: sums of bytes, of rows that were changed and of time in locks, flags and first times."""
    events = read_slow_log(spark, _dialect_log(spark, sf_dir), split_bytes=1 << 20).withColumn("class_id", F.col("database"))
    names = ("calls", "bytes_sent", "rows_affected_sum", "rows_affected_max", "lock_time_us_sum", "filesort_count", "tmp_table_count", "first_seen")
    return P.class_profile(events).select(F.col("class_id").alias("database"), *names)


@_query(f"""WITH {_EVENTS} SELECT 'select ? from orders' AS fingerprint, count(*) AS calls, count(DISTINCT database) AS databases, max(query_time_us) AS most FROM ev""")
def log_classes(spark, sf_dir):
    events = with_fingerprints(read_slow_log(spark, _dialect_log(spark, sf_dir)))
    return events.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("database").alias("databases"), F.max("query_time_us").alias("most"))


_BYTES = "CASE WHEN n < 1024 THEN n || ' B' " + " ".join(f"WHEN n < {1024 ** (k + 1)} THEN printf('%.1f {u}', n / {1024**k}.0)" for k, u in enumerate(("KB", "MB", "GB"), 1)) + f" ELSE printf('%.1f TB', n / {1024**4}.0) END"
_IN_THREES = lambda k, u: f"CASE WHEN n / {1000**k}.0 < 100 THEN printf('%.1f{u}', n / {1000**k}.0) ELSE printf('%.0f{u}', n / {1000**k}.0) END"
_COMPACT = "CASE WHEN n < 1000 THEN n::VARCHAR " + " ".join(f"WHEN n < {1000 ** (k + 1)} THEN {_IN_THREES(k, u)}" for k, u in enumerate("kMB", 1)) + f" ELSE {_IN_THREES(4, 'T')} END"
_DURATION = """CASE WHEN s < 0.001 THEN printf('%.0f µs', s * 1e6) WHEN s < 0.1 THEN printf('%.1f ms', s * 1e3) WHEN s < 1 THEN printf('%.0f ms', s * 1e3) WHEN s < 10 THEN printf('%.2f s', s)
               WHEN s < 60 THEN printf('%.1f s', s) WHEN floor(s + 0.5) < 3600 THEN printf('%dm %02ds', floor(s + 0.5)::BIGINT // 60, floor(s + 0.5)::BIGINT % 60)
               WHEN floor(s + 0.5) < 86400 THEN printf('%dh %02dm', floor(s + 0.5)::BIGINT // 3600, floor(s + 0.5)::BIGINT % 3600 // 60)
               ELSE printf('%dd %02dh', floor(s + 0.5)::BIGINT // 86400, floor(s + 0.5)::BIGINT % 86400 // 3600) END"""


@_query(f"""SELECT o_orderkey, {_BYTES} AS bytes, {_COMPACT} AS compact, {_DURATION} AS duration, CASE WHEN length(t) <= 9 THEN t ELSE rtrim(substr(t, 1, 8), ' ') || '…' END AS short, len(string_split(o_orderpriority, '-')) AS parts,
            array_to_string(string_split(o_orderpriority, '-'), '+') AS joined, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey || '.5')::DOUBLE END AS number
            FROM (SELECT *, o_orderkey * o_orderkey * 1024 AS n, (o_orderkey * o_orderkey % 100000007) / 8192.0::DOUBLE AS s, trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g')) AS t FROM orders)""")
def format_functions(spark, sf_dir):
    """Sizes, counts, durations and texts for people, as columns."""
    k, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    n, s = k * k * 1024, (k * k % 100_000_007) / F.lit(8192.0)
    number = F.concat(k.cast("string"), F.when(k % 2 == 0, ".5").otherwise(".5.5"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", C.format_bytes(n).alias("bytes"), C.format_compact(n).alias("compact"), C.format_duration(s).alias("duration"), C.abbreviate(priority, 9).alias("short"), F.size(C.split_text(priority, "-")).cast("long").alias("parts"),
        C.join_texts(C.split_text(priority, "-"), "+").alias("joined"), C.parse_double(number).alias("number"),
    )
