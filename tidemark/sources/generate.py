"""Synthetic slow logs: weighted scenarios of a parcel service, each event drawn from hashes of its number.

The same seed and number give the same event on any cluster.  The distributions are those of the table below; the
statements and the bytes are this package's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the workload: weight, median milliseconds, sigma, rows examined, rows sent, flags (s scan, f sort,
#: t temporary table, d on disk).
FIGURES = (
    (30.0, 0.18, 0.4, 1, 1, ""),
    (20.0, 0.12, 0.3, 1, 1, ""),
    (12.0, 42.0, 0.5, 3_200, 20, "f"),
    (10.0, 180.0, 0.35, 480_000, 3, "s"),
    (8.0, 0.9, 0.5, 0, 0, ""),
    (8.0, 1.3, 0.5, 0, 0, ""),
    (8.0, 115.0, 0.3, 200_000, 1, "s"),
    (6.0, 0.7, 0.4, 1, 0, ""),
    (6.0, 88.0, 0.4, 50_000, 50, "sf"),
    (5.0, 3.0, 0.4, 40, 20, "f"),
    (4.0, 125.0, 0.3, 200_000, 1, "s"),
    (3.0, 62.0, 0.3, 100_000, 8, "sft"),
    (2.0, 140.0, 0.3, 200_000, 1, "s"),
    (1.0, 28.0, 0.3, 320, 320, ""),
    (1.0, 870.0, 0.25, 2_000_000, 30, "st"),
    (0.5, 74.0, 0.2, 5_000, 11, "t"),
    (0.5, 790.0, 0.3, 300_000, 0, "s"),
    (0.3, 2_400.0, 0.2, 5_000_000, 1_200, "std"),
    (0.1, 7_900.0, 0.15, 50_000_000, 1, "s"),
    (0.05, 3_100.0, 0.1, 200_000, 0, "s"),
)
#: The statement of each scenario; the marks stand for a number, a small number, a digest and a list of numbers.
STATEMENTS = (
    "SELECT parcel_no, weight_g, state FROM parcels WHERE parcel_no = {n}",
    "SELECT courier_id, valid_until FROM badges WHERE code = '{h}'",
    "SELECT parcel_no, weight_g FROM parcels WHERE depot_id = {n} AND state = 'held' ORDER BY arrived_at DESC LIMIT 15",
    "SELECT s.place, s.noted_at, c.nickname\nFROM scans AS s\nINNER JOIN couriers AS c ON c.courier_id = s.courier_id\nWHERE s.parcel_no = {n}",
    "INSERT INTO parcels (depot_id, state, weight_g, arrived_at) VALUES ({n}, 'held', {m}, CURRENT_TIMESTAMP)",
    "INSERT INTO scans (parcel_no, courier_id, place) VALUES ({n}, {m}, 'gate'), ({n}, {m}, 'ramp')",
    "SELECT courier_id, nickname FROM couriers WHERE UPPER(licence) = 'LC-{n}'",
    "UPDATE parcels SET state = 'sent', left_at = CURRENT_TIMESTAMP WHERE parcel_no = {n}",
    "SELECT depot_id, street FROM depots WHERE street LIKE '%lane {m}' ORDER BY city LIMIT 25",
    "SELECT noted_at, place FROM scans WHERE courier_id = {n} ORDER BY noted_at LIMIT 3000, 25",
    "SELECT courier_id, nickname FROM couriers WHERE mobile = 4470{m}",
    "SELECT parcel_no FROM parcels ORDER BY RAND() LIMIT 5",
    "SELECT depot_id, open FROM depots WHERE city = 'town {n}' OR postcode = 'P{m}'",
    "SELECT parcel_no, state FROM parcels WHERE parcel_no IN ({list})",
    "SELECT YEAR(left_at) AS y, COUNT(*) AS sent FROM parcels WHERE YEAR(left_at) = 2023 GROUP BY YEAR(left_at)",
    "SELECT state, MAX(weight_g) AS heaviest FROM parcels GROUP BY state HAVING state <> 'lost'",
    "DELETE FROM badges WHERE valid_until < '2023-06-01'",
    "SELECT nickname FROM couriers WHERE courier_id NOT IN (SELECT courier_id FROM scans)",
    "SELECT COUNT(*) FROM depots, couriers WHERE depots.city = 'Porto'",
    "UPDATE depots SET open = 1",
)
SCENARIOS = tuple((*figures, statement) for figures, statement in zip(FIGURES, STATEMENTS, strict=True))
#: First second, largest gap in microseconds, and how often an event is an administrator command.
START, GAP_US, ADMIN_EVERY = 1_705_312_800, 40_000, 250


def _unit(seed: int, number: Column, draw: int) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), number, F.lit(draw)), F.lit(1 << 40)).cast("double") / float(1 << 40)


def generate_events(spark: SparkSession, events: int = 10_000, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``seq, scenario, sql, user, host, ip, thread_id, query_time_us, lock_time_us, rows_sent, rows_examined, ts, flags, admin``."""
    n = F.col("id")
    table = spark.range(0, events, 1, partitions) if partitions else spark.range(events)
    total, upto, pick = sum(s[0] for s in SCENARIOS), 0.0, F.lit(len(SCENARIOS) - 1)
    marks = []
    for k, s in enumerate(SCENARIOS):
        upto += s[0]
        marks.append((k, upto / total))
    for k, mark in reversed(marks):
        pick = F.when(F.col("u") < mark, F.lit(k)).otherwise(pick)

    def of(field: int, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(s[field]) for s in SCENARIOS)), F.col("scenario") + 1).cast(kind)

    drawn = table.select(n.alias("seq"), _unit(seed, n, 0).alias("u"), *(_unit(seed, n, d).alias(f"u{d}") for d in range(1, 7)))
    drawn = drawn.withColumn("scenario", pick.cast("int")).withColumn("admin", (F.pmod(F.xxhash64(F.lit(seed), F.col("seq"), F.lit(9)), F.lit(ADMIN_EVERY)) == 0))
    normal = F.sqrt(-2 * F.log(F.greatest(F.col("u1"), F.lit(1e-12)))) * F.cos(F.lit(6.283185307179586) * F.col("u2"))
    number, small = (F.col("u3") * 200_000 + 1).cast("long").cast("string"), (F.col("u4") * 900 + 100).cast("long").cast("string")
    ids = F.array_join(F.transform(F.sequence(F.lit(1), (250 + F.col("u5") * 150).cast("int")), lambda i: (i * 7).cast("string")), ", ")
    sql = of(6, "string")
    for mark, value in (("{n}", number), ("{m}", small), ("{h}", F.sha2(number, 256)), ("{list}", ids)):
        sql = F.replace(sql, F.lit(mark), value)
    return drawn.select(
        "seq",
        "scenario",
        sql.alias("sql"),
        F.lit("clerk").alias("user"),
        F.concat(F.lit("desk-"), (F.col("u5") * 3 + 1).cast("int").cast("string")).alias("host"),
        (F.col("u6") * 24 + 8).cast("long").alias("thread_id"),
        F.when(F.col("admin"), F.lit(3)).otherwise(F.greatest(F.lit(1), (of(1, "double") * 1000 * F.exp(of(2, "double") * normal)).cast("long"))).cast("long").alias("query_time_us"),
        F.lit(2).cast("long").alias("lock_time_us"),
        of(4, "long").alias("rows_sent"),
        of(3, "long").alias("rows_examined"),
        (F.lit(START) + F.floor(F.col("seq") * (GAP_US // 2) / 1_000_000)).cast("long").alias("ts"),
        of(5, "string").alias("flags"),
        "admin",
    )


def log_text(events: DataFrame, extra_fields: bool = True, database: str = "post") -> DataFrame:
    """``seq, value``: the text of each event, without the last line feed; only event 0 names the database."""
    seconds = lambda c: F.format_string("%d.%06d", F.floor(F.col(c) / 1_000_000), F.col(c) % 1_000_000)
    flag = lambda letter, yes: F.when(F.contains("flags", F.lit(letter)), F.lit(yes)).otherwise(F.lit("0"))
    more = F.concat(
        F.lit("  Thread_id: "), F.col("thread_id").cast("string"), F.lit(" Bytes_sent: "), (F.col("rows_sent") * 72).cast("string"),
        F.lit(" Read_rnd_next: "), F.when(F.contains("flags", F.lit("s")), F.col("rows_examined").cast("string")).otherwise(F.lit("0")),
        F.lit(" Sort_scan_count: "), flag("f", "1"), F.lit(" Created_tmp_disk_tables: "), flag("d", "1"), F.lit(" Created_tmp_tables: "), flag("t", "1"),
    )
    parts = [
        F.concat(F.lit("# Time: "), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000000Z")),
        F.concat(F.lit("# User@Host: "), F.col("user"), F.lit("["), F.col("user"), F.lit("] @ "), F.col("host"), F.lit(" []  Id: "), F.col("thread_id").cast("string")),
        F.concat(F.lit("# Query_time: "), seconds("query_time_us"), F.lit("  Lock_time: "), seconds("lock_time_us"), F.lit(" Rows_sent: "), F.col("rows_sent").cast("string"), F.lit("  Rows_examined: "), F.col("rows_examined").cast("string"), more if extra_fields else F.lit("")),
        F.when(F.col("seq") == 0, F.lit(f"use {database};")),
        F.concat(F.lit("SET timestamp="), F.col("ts").cast("string"), F.lit(";")),
        F.when(F.col("admin"), F.lit("# administrator command: Quit;")).otherwise(F.concat(F.col("sql"), F.lit(";"))),
    ]
    return events.select("seq", F.concat_ws("\n", *parts).alias("value"))


def write_log(spark: SparkSession, path: str, events: int = 10_000, seed: int = 42, extra_fields: bool = True, files: int = 1) -> None:
    """Write a generated log as text files whose names ascend with time."""
    text = log_text(generate_events(spark, events, seed), extra_fields)
    ordered = text.repartitionByRange(files, "seq").sortWithinPartitions("seq") if files > 1 else text.coalesce(1).sortWithinPartitions("seq")
    ordered.select("value").write.mode("overwrite").text(path)
