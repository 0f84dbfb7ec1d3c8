"""Slow-log parsing, splitting and the data source."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.sources.records import Parser, cuts, parse_log_time, parse_microseconds, parse_text, parsed_parts
from tidemark.sources.slowlog import log_counters, read_log_text, read_slow_log, settled, stream_slow_log

MYSQL = """/opt/db/bin/mysqld, Version: 8.0.36 (Source). started with:
Tcp port: 3399  Unix socket: /run/db.sock
Time                 Id Command    Argument
# Time: 2023-07-02T08:00:01.500000Z
# User@Host: clerk[clerk] @ desk-4 [192.168.7.20]  Id:   801
# Query_time: 0.251007  Lock_time: 0.000019 Rows_sent: 15  Rows_examined: 41000 Thread_id: 801 Bytes_sent: 977 Read_rnd_next: 0 Sort_scan_count: 2 Created_tmp_tables: 0
use post;
SET timestamp=1688284801;
SELECT parcel_no
# held ones only
FROM parcels;
# Time: 2023-07-02T08:00:09.000000Z
# User@Host: batch[batch] @  [10.20.30.40]  Id: 802
# Query_time: 7.75  Lock_time: 0.0 Rows_sent: 2  Rows_examined: 6 Read_rnd_next: 4 Created_tmp_tables: 3 Created_tmp_disk_tables: 1
SELECT 40 + 2;
# Time: 2023-07-02T08:01:00Z
# User@Host: batch[batch] @ localhost []  Id: 802
# Query_time: 0.3  Lock_time: 0 Rows_sent: 0  Rows_examined: 0
# administrator command: Quit;
"""
OTHERS = """# Time: 230702  9:15:30
# User@Host: sorter[sorter] @ hub-2 [10.9.8.7]
# Thread_id: 77  Schema: post  QC_hit: No
# Query_time: 1.250000  Lock_time: 0.0  Rows_sent: 0  Rows_examined: 5400  Rows_affected: 12
# Full_scan: Yes  Filesort: Yes  Tmp_table: No  Stored_routine:
update parcels set state = 'late';
# User@Host: sorter[sorter] @ hub-2 [10.9.8.7]
# Thread_id: 78  Schema:
# Query_time: 0.125  Lock_time: 0.0
use archive;
select 9;\r
"""


@pytest.mark.parametrize(("text", "value"), [("0.000123", 123), ("12.5", 12_500_000), ("3", 3_000_000), (".25", 250_000), ("0.0000015", 2), ("0.0000014", 1), ("", None), (".", None), ("1.2s", None), ("-1", None)])
def test_microseconds(text, value):
    assert parse_microseconds(text) == value


def test_times():
    assert parse_log_time(" 2023-07-02T08:00:01.5Z") == parse_log_time("2023-07-02T05:30:01.500000-02:30") == 1688284801
    assert parse_log_time("230702 08:00:01") == 1688284801 and parse_log_time("230702  9:15:30") == 1688289330
    assert parse_log_time("nonsense") is None and parse_log_time("2023-00-02T08:00:01Z") is None


def test_mysql_dialect():
    p = parse_text(MYSQL)
    assert (p.seen, p.skipped) == (2, 1)
    first, second = p.events
    assert first[1:] == ("SELECT parcel_no\n# held ones only\nFROM parcels", "post", "clerk", "desk-4", 251007, 19, 15, 41000, 0, 977, 801, 1688284801, False, True, False, False)
    assert second[2:6] == ("post", "batch", "10.20.30.40", 7_750_000) and second[13:] == (True, False, True, True)


def test_other_dialects():
    first, second = parse_text(OTHERS).events
    assert first[2] == "post" and first[9] == 12 and first[11] == 77 and first[13:] == (True, True, False, False) and first[12] == 1688289330
    assert second[1:3] == ("select 9", "archive") and second[11] == 78


def big_log(events=900):
    out = []
    for k in range(events):
        out.append(f"# Time: 2024-01-15T10:{k // 60 % 60:02d}:{k % 60:02d}Z\n# User@Host: a[a] @ h{k % 3} []  Id: {k}\n# Query_time: 0.{k:06d} Lock_time: 0 Rows_sent: {k % 5} Rows_examined: {k}\n")
        if k % 150 == 40:
            out.append(f"use db{k // 150 % 4};\n")
        out.append(f"SELECT {k}\n  FROM t{k % 7};\n" if k % 100 else "# administrator command: Ping;\n")
    return "".join(out)


@pytest.mark.parametrize("parts", [1, 2, 7, 16])
def test_pieces_are_the_whole(parts):
    text = big_log()
    starts = cuts(text, parts)
    pieces = parsed_parts(text, starts)
    whole = parse_text(text)
    assert len(starts) == parts and sum(p.lines for p in pieces) == whole.lines and sum(p.skipped for p in pieces) == whole.skipped
    assert [e[:2] + e[3:] for p in pieces for e in p.events] == [e[:2] + e[3:] for e in whole.events]


@given(st.lists(st.sampled_from(["# Time: 240115 10:23:45\n", "# User@Host: a[a] @ b []\n", "# Query_time: 1 Lock_time: 0\n", "use x;\n", "select 1;\n", "SET timestamp=5;\n", "# administrator command: Quit;\n", "junk\n", "\r\n", "mysqld started with:\n", "#\n", "# Schema: y\n"]), max_size=40).map("".join), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_any_log_parses(text, parts):
    whole = parse_text(text)
    assert whole.seen == len(whole.events)
    assert all(e[1] for e in whole.events) and cuts(text, parts)[0] == 0


def test_source_is_split_invariant(spark, tmp_path):
    text = big_log()
    path = tmp_path / "slow.log"
    path.write_text(text)
    want = parse_text(text)
    for split in (1 << 20, 9000):
        got = read_slow_log(spark, str(path), split).orderBy("seq").collect()
        assert [tuple(r) for r in got] == want.events
        assert log_counters(spark, str(path), split).first()[:3] == (want.lines, want.seen, want.skipped)
    assert [tuple(r) for r in read_log_text(spark, text).orderBy("seq").collect()] == want.events


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    from tidemark.sources import slowlog

    text = big_log(300)
    path = tmp_path / "slow.log"
    path.write_text(text)
    (tmp_path / "empty.log").write_text("")
    ranges = -(-len(text.encode()) // 500)
    frame = slowlog._raw(spark, str(path), 500)
    assert frame.rdd.getNumPartitions() == 1 and frame.where("kind = 'end'").count() == ranges
    assert [tuple(r) for r in read_slow_log(spark, str(path), 500).orderBy("seq").collect()] == parse_text(text).events
    monkeypatch.setattr(slowlog, "TASK_BYTES", 20_000)
    reader = slowlog._Reader(str(tmp_path), 500, False)
    empty, *tasks = reader.partitions()
    assert [len(empty.ranges), sum(len(t.ranges) for t in tasks)] == [1, ranges] and len(tasks) <= len(text.encode()) // 19_500 + 1
    whole = [r for t in tasks for r in t.ranges]
    assert whole[0].start == 0 and all(a.end == b.start and a.split < b.split for a, b in zip(whole, whole[1:], strict=False))
    rows = [r for t in tasks for batch in reader.read(t) for r in batch.to_pylist()]
    assert [r["seq"] for r in rows if r["kind"] == "event"] == [e[0] for e in parse_text(text).events]
    assert [r["split"] for r in rows if r["kind"] == "end"] == [r.split for r in whole]


def test_the_database_carries_over_ranges_of_a_few_tasks(spark, tmp_path):
    from tidemark.sources.slowlog import resolved_events, scan_slow_log

    text = "use first;\n" + "".join(OTHERS.replace("use archive;", f"use db{k};" if k % 9 == 0 else "#") for k in range(60))
    path = tmp_path / "slow.log"
    path.write_text(text.replace("#\nselect", "# \nselect"))  # a header line without a word
    raw = scan_slow_log(spark, str(path), 150)
    assert len(raw.inputFiles()) == 1 and raw.where("kind = 'end'").count() > 100
    got = [r.database for r in resolved_events(raw, "none").orderBy("seq").collect()]
    assert got == [x for k in range(60) for x in ("post", f"db{k // 9 * 9}")]


def test_a_cut_reads_little():
    import io

    from tidemark.sources.slowlog import cut_at

    class Counted(io.BytesIO):
        taken = 0

        def read(self, size=-1):
            data = super().read(size)
            self.taken += len(data)
            return data

    data = (MYSQL + OTHERS).encode() * 1000
    for least in range(1, len(data), len(data) // 50):
        stream = Counted(data)
        cut = cut_at(stream, len(data), least)
        assert least <= cut <= least + len(MYSQL + OTHERS) and (cut == len(data) or data.startswith((b"# Time:", b"# User@Host:"), cut))
        assert stream.taken <= 16_384


def test_fingerprints_of_the_source_are_those_of_the_column(spark, tmp_path):
    from tidemark.functions.statements import with_fingerprints
    from tidemark.sources.slowlog import resolved_events, scan_slow_log

    (tmp_path / "slow.log").write_text(big_log(300) + MYSQL)
    plain, classed = (resolved_events(scan_slow_log(spark, str(tmp_path / "slow.log"), 9000, f)) for f in (False, True))
    assert with_fingerprints(classed).columns == with_fingerprints(plain).columns == classed.columns
    assert sorted(map(str, with_fingerprints(plain).collect())) == sorted(map(str, classed.collect()))


def test_several_files_bad_bytes_and_nothing(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_bytes(MYSQL.encode() + b"")
    (tmp_path / "logs" / "b.log").write_bytes(OTHERS.encode().replace(b"select 9", b"select '\xff'"))
    (tmp_path / "logs" / "c.log").write_bytes(b"")
    rows = read_slow_log(spark, str(tmp_path / "logs")).orderBy("seq").collect()
    assert [r.sql for r in rows][-1] == "select '�'" and len(rows) == 4
    with pytest.raises(Exception, match="no slow log"):
        read_slow_log(spark, str(tmp_path / "missing")).count()


def test_stream_agrees_with_batch(spark, tmp_path):
    path = tmp_path / "slow.log"
    path.write_text(big_log(300))
    query = stream_slow_log(spark, str(path), 5000).groupBy("database").count().writeStream.format("memory").queryName("log_stream").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = read_slow_log(spark, str(path)).groupBy("database").count()
    assert {tuple(r) for r in spark.table("log_stream").collect()} == {tuple(r) for r in batch.collect()}


def micro_batches(spark, folder, steps, tmp_path, split_bytes=4000):
    """Rows that a stream gives after each step, a function that changes the log."""
    seen = []
    frame = stream_slow_log(spark, str(folder), split_bytes)
    for step in steps:
        step()
        batch = []
        query = frame.writeStream.foreachBatch(lambda df, _, batch=batch: batch.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        seen.append(sorted((r.seq, r.sql, r.database) for r in batch))
    return seen


def test_a_half_written_event_waits(spark, tmp_path):
    log = tmp_path / "slow.log"
    text = big_log(120)
    cuts_at = [text.index("SELECT 50\n") + 9, text.index("SELECT 50\n") + 14, text.index("# User@Host", len(text) // 2) + 5, text.rindex("SELECT") + 3, len(text) - 1, len(text)]
    want = [(e[0], e[1], e[2]) for e in parse_text(text).events]
    steps = [lambda n=n: log.write_text(text[:n]) for n in cuts_at]
    seen = micro_batches(spark, log, steps, tmp_path)
    assert [r for batch in seen for r in batch] == want
    assert not any(r[1].startswith("SELECT 50") for r in seen[0] + seen[1]) and sum(len(b) > 0 for b in seen) >= 3


def test_a_rotated_log_goes_on(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    text, other = big_log(60), "# Time: 2024-02-01T00:00:00Z\n# User@Host: z[z] @ h []  Id: 1\n# Query_time: 1 Lock_time: 0 Rows_sent: 0 Rows_examined: 0\nselect 'new';\n"
    half = text.index("# Time", len(text) // 2)

    def rotate():
        (folder / "slow.log").write_text(text)
        (folder / "slow.log").rename(folder / "slow.log.1")
        (folder / "slow.log").write_text(other)

    seen = micro_batches(spark, folder, [lambda: (folder / "slow.log").write_text(text[:half]), rotate], tmp_path)
    whole = [e[1] for e in parse_text(text).events]
    assert [r[1] for r in seen[0]] + sorted(r[1] for r in seen[1] if "new" not in r[1]) == [r[1] for r in seen[0]] + sorted(whole[len(seen[0]) :])
    assert [r[1] for r in seen[1] if "new" in r[1]] == ["select 'new'"]


@given(st.integers(0, 4000))
@settings(max_examples=150, deadline=None)
def test_settled_loses_nothing(size):
    import io

    text = (MYSQL + OTHERS + big_log(8)).encode()
    size = min(size, len(text))
    at = settled(io.BytesIO(text), size)
    assert 0 <= at <= size
    events = lambda a, b: [e[:2] for p in parsed_parts(text[:b].decode(), [a]) for e in p.events] if b > a else []
    assert events(0, at) + events(at, len(text)) == events(0, len(text))


@given(st.lists(st.sampled_from(["# Time: 2024-01-15T10:23:45.5Z\n", "# User@Host: a[a] @ b []  Id:  7\n", "# User@Host: a-b[a-b] @ h.x [1.2.3.4]  Id: 8\n", "# Query_time: 1.000002  Lock_time: 0.000001 Rows_sent: 3  Rows_examined: 4\n",
    "# Query_time: 1.000002  Lock_time: 0.000001 Rows_sent: 3  Rows_examined: 4 Thread_id: 9 Bytes_sent: 72 Read_rnd_next: 5 Sort_scan_count: 0 Created_tmp_disk_tables: 1\n", "SET timestamp=5;\n", "use x;\n", "select 1;\n", "select 'é\n", "  from t;\n", ";\n", "set a = 1;\n",
    "select ';';\r\n", "x started with:\n", "Tcp port: 5\n", "# comment;\n", "# administrator command: Quit;\n", "\n"]), max_size=60).map("".join), st.booleans())
@settings(max_examples=400, deadline=None)
def test_events_taken_whole_are_those_read_line_by_line(text, common):
    header = "# Time: 2024-01-15T10:23:45.5Z\n# User@Host: a[a] @ b []  Id:  7\n# Query_time: 1.000002  Lock_time: 0.000001 Rows_sent: 3  Rows_examined: 4\nSET timestamp=6;\nselect 2\nfrom u;\n"
    text = header + text + header * 2 if common else text
    data, slow, fast = text.encode(), Parser(""), Parser("")
    at = 0
    for line in data.split(b"\n")[: data.count(b"\n")]:
        slow.feed(line.decode(), at)
        at += len(line) + 1
    fast.feed_bytes(data, 0, len(data))
    for p in (slow, fast):
        p.finish()
    assert (fast.events, fast.lines, fast.seen, fast.skipped, fast.database) == (slow.events, slow.lines, slow.seen, slow.skipped, slow.database)


def test_the_generated_log_is_taken_whole(spark, tmp_path, monkeypatch):
    from tidemark.sources import generate, records

    generate.write_log(spark, f"{tmp_path}/log", 400, 7)
    data = b"".join(p.read_bytes() for p in (tmp_path / "log").glob("part*"))
    taken = []
    real = records.Parser._common
    monkeypatch.setattr(records.Parser, "_common", lambda self, *a: taken.append(real(self, *a)) or taken[-1])
    parser = Parser("")
    parser.feed_bytes(data, 0, len(data))
    parser.finish()
    assert parser.events == parse_text(data.decode()).events and sum(taken) > 380
