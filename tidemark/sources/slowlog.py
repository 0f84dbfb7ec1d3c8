"""Slow logs as DataFrames: a splittable Python data source, batch and streaming, and the carried database.

``format("slowlog")`` cuts each file into byte ranges; a range owns the events that start in it and is read on to the
end of the last one.  A range is parsed without knowledge of the database in force at its start: it is left null, and
the last ``use`` of the range is reported; ``read_slow_log`` parses once, into the shared folder, and fills the gaps from
those reports, one row per range, by a running ``last`` over the ranges in file order.  A task takes small ranges that
follow each other together, so that their number does not become one of tasks and files.

A stream ends each batch where the last event of a file is known to be whole, so a half-written event waits for its
rest.  Its offset holds, for each file, that place, the file's size, a checksum of its first bytes and the database in
force there: a file whose size falls or whose first bytes change is read anew, and one that was renamed goes on.
"""

from __future__ import annotations

import glob
import os
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.profile import EVENT_COLUMNS
from ..shipping import ship
from .records import Boundaries, Parser
from .scratch import stage

RAW = f"kind string, split long, {EVENT_COLUMNS}, lines long, events long, skipped long, last_use string"
CLASSED = ", class_id string, fingerprint string, statement_kind string"  # with the option ``fingerprints``
SPLIT_BYTES = 64 << 20
TASK_BYTES = 8 << 20  # a task takes ranges of a file up to so many bytes
BROADCAST_RANGES = 1 << 16  # one row of a number and a name per range: a few MB
_BLOCK = 1 << 20


def filesystem(uri: str):
    """The Arrow filesystem of a URI and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def _files(uri: str) -> list[tuple[str, int]]:
    """(path, size) of the regular files that a path, a folder or a pattern names, in name order."""
    from pyarrow import fs

    system, path = filesystem(uri)
    if isinstance(system, fs.LocalFileSystem) and any(c in path for c in "*?["):
        names = sorted(glob.glob(path))
    elif system.get_file_info(path).type == fs.FileType.Directory:
        names = sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if not os.path.basename(x.path).startswith(("_", ".")))
    else:
        names = [path]
    infos = system.get_file_info(names)
    if not infos or any(x.type == fs.FileType.NotFound for x in infos):
        raise FileNotFoundError(f"no slow log at {uri}")
    return [(x.path, x.size) for x in infos if x.type == fs.FileType.File]


class _Range(InputPartition):
    """Bytes of a file.  A stream's range also has the bytes of the whole batch and the database in force where it begins."""

    def __init__(self, uri: str, path: str, start: int, end: int, split: int, batch: tuple[int, int] | None = None, use: str | None = None):
        self.uri, self.path, self.start, self.end, self.split, self.batch, self.use = uri, path, start, end, split, batch, use


class _Task(InputPartition):
    """Ranges of one file that follow each other."""

    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


def _tasks(ranges: list[_Range]) -> list[_Task]:
    """Ranges in order, as many to a task as ``TASK_BYTES`` hold; a larger range is a task of its own."""
    out: list[_Task] = []
    taken = 0
    for split in ranges:
        size = split.end - split.start
        if not out or taken + size > TASK_BYTES or out[-1].ranges[-1].path != split.path:
            out.append(_Task([]))
            taken = 0
        out[-1].ranges.append(split)
        taken += size
    return out


def _lines_from(stream, at: int, step: int = _BLOCK):
    """(line, place) from a place that begins a line; lines keep bytes that are no UTF-8 as surrogates.

    ``step`` is the size of the first read; further ones grow.
    """
    stream.seek(at)
    rest = b""
    while block := stream.read(step):
        step = min(2 * step, _BLOCK)
        rest += block
        whole, found, tail = rest.rpartition(b"\n")
        if found:
            for line in whole.split(b"\n"):
                yield line.decode("utf-8", "surrogateescape"), at
                at += len(line) + 1
            rest = tail
    if rest:
        yield rest.decode("utf-8", "surrogateescape"), at


def _line_before(stream, at: int) -> int:
    """Start of the line before the one that ``at`` lies in, or of that line if it is the first."""
    end, data, wanted = at, b"", 2
    while end > 0:
        step = min(end, 4096)
        stream.seek(end - step)
        data = stream.read(step) + data
        end -= step
        if data.count(b"\n") >= wanted:
            cut = data.rfind(b"\n", 0, data.rfind(b"\n"))
            return end + cut + 1
    return 0


def cut_at(stream, size: int, least: int) -> int:
    """First event start at or after ``least``, or the end of the file; without user lines, a ``# Time:`` line."""
    if least <= 0 or least >= size:
        return max(0, min(least, size))
    finder, timed = Boundaries(least), None
    for line, at in _lines_from(stream, _line_before(stream, least), 4096):
        if (cut := finder.next(line, at)) is not None:
            return cut
        if timed is None and at >= least and line.startswith("# Time:"):
            timed = at
    return size if timed is None else timed


def _use_before(stream, at: int, floor: int = 0) -> str | None:
    """The database of the last line in ``[floor, at)`` that reads ``use name;``; ``floor`` begins a line."""
    tail = b""
    while at > floor:
        step = min(at - floor, _BLOCK)
        stream.seek(at - step)
        data, at = stream.read(step) + tail, at - step
        lines = data.split(b"\n")
        for line in reversed(lines if at == floor else lines[1:]):
            text = line.strip()
            if text[:4].lower() == b"use " and text.endswith(b";"):
                return text[4:-1].strip().strip(b"`").decode("utf-8", "replace")
        tail = lines[0] if at > floor else b""
    return None


def _last_start(stream, size: int) -> int:
    """Where the last event that begins before ``size`` begins; 0 if none does."""
    tail, at = b"", size
    while True:
        step = min(at, _BLOCK)
        stream.seek(at - step)
        tail, at = stream.read(step) + tail, at - step
        text, base = (tail, at) if at else (b"\n" + tail, -1)
        if (found := text.rfind(b"\n# User@Host:")) >= 0:
            before = text.rfind(b"\n", 0, found)
            if before >= 0 or at == 0:
                timed = before >= 0 and text.startswith(b"# Time:", before + 1)
                return base + (before if timed else found) + 1
        if at == 0:
            return max(0, base + text.rfind(b"\n# Time:") + 1)


def settled(stream, size: int) -> int:
    """The largest place up to ``size`` before which every event is whole: ``size``, or where an unfinished event begins.

    The last event is whole if its statement has begun and its last line is complete and ends in a semicolon, or is an
    administrator command.
    """
    start = _last_start(stream, size)
    stream.seek(max(0, size - 1))
    if size and stream.read(1) != b"\n":
        return start
    parser, last = Parser(None), ""
    for line, at in _lines_from(stream, start):
        if at >= size:
            break
        parser.feed(line, at)
        last = line.strip() or last
    pending = parser.state == "header" or parser.state == "body" and not (parser.event["admin"] or last.endswith(";"))
    return start if pending else size


def _head(stream, size: int) -> list[int]:
    """How many first bytes tell a file from others, and their checksum."""
    stream.seek(0)
    data = stream.read(min(size, 256))
    return [len(data), zlib.crc32(data)]


def _clean(text):
    """Text that Arrow accepts: bytes that are no UTF-8 become U+FFFD."""
    return text if text is None or text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _batches(task: _Task, classed: bool):
    import pyarrow as pa

    from ..functions.statements import classifier

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in (RAW + CLASSED * classed).split(", ")]
    class_of = classifier() if classed else None

    def table(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    splits, rows, ends = [], [], []  # of the ranges so far, not yet given away

    def events():
        columns = [list(c) for c in zip(*rows, strict=True)]
        for k in (1, 2, 3, 4):
            columns[k] = [_clean(x) for x in columns[k]]
        n = len(rows)
        classes = [list(c) for c in zip(*map(class_of, columns[1]), strict=True)] if classed else []
        out = table([["event"] * n, list(splits), *columns, *([None] * n for _ in range(4)), *classes])
        splits.clear()
        rows.clear()
        return out

    def reports():
        n = len(ends)
        number, *figures = (list(c) for c in zip(*ends, strict=True))
        ends.clear()
        return table([["end"] * n, number, *([None] * n for _ in range(17)), *figures, *([[None] * n] * 3 if classed else [])])

    system, _ = filesystem(task.ranges[0].uri)
    with system.open_input_file(task.ranges[0].path) as stream:
        size, cuts = stream.size(), {}
        for split in task.ranges:
            cuts = {at: cuts[at] if at in cuts else cut_at(stream, size, at) for at in (split.start, split.end)}  # one range's end is the next one's start
            start, end = cuts[split.start], cuts[split.end]
            parser = Parser()
            if split.batch:  # which begins and ends at an event's start
                low, high = split.batch
                start, end = (at if at in split.batch else min(high, cut) for at, cut in ((split.start, start), (split.end, end)))
                parser.database = _use_before(stream, start, low) or split.use
            stream.seek(start)
            held, place = b"", start
            while place < end:
                block = stream.read(min(_BLOCK, end - place))
                held, place = held + block, place + len(block)
                upto = len(held) if place >= end or not block else max(held.rfind(b"\n# Time: "), held.rfind(b"\n# User@Host: ")) + 1
                if upto or len(held) > 16 * _BLOCK:
                    upto = upto or held.rfind(b"\n") + 1
                    parser.feed_bytes(held, place - len(held), upto)
                    held = held[upto:]
                    splits += [split.split] * len(parser.events)
                    rows += parser.events
                    parser.events = []
                    if len(rows) >= 8192:
                        yield events()
                if not block:
                    break
            parser.finish()
            splits += [split.split] * len(parser.events)
            rows += parser.events
            ends.append((split.split, parser.lines, parser.seen, parser.skipped, _clean(parser.database)))
            if len(rows) >= 8192:
                yield events()
            if len(ends) >= 8192:
                yield reports()
        if rows:
            yield events()
    if ends:
        yield reports()


class _Reader(DataSourceReader):
    def __init__(self, uri: str, split_bytes: int, classed: bool):
        self.uri, self.split_bytes, self.classed = uri, split_bytes, classed

    def partitions(self):
        out = []
        for number, (path, size) in enumerate(_files(self.uri)):
            count = max(1, -(-size // self.split_bytes))
            out += [_Range(self.uri, path, size * k // count, size * (k + 1) // count, (number << 32) + k) for k in range(count)]
        return _tasks(out)

    def read(self, partition):
        return _batches(partition, self.classed)


class _StreamReader(DataSourceStreamReader):
    """Every batch takes each file from where the last one ended to where its events are whole now."""

    def __init__(self, uri: str, split_bytes: int, classed: bool):
        self.uri, self.split_bytes, self.classed = uri, split_bytes, classed
        self.known: dict[str, dict] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        system, _ = filesystem(self.uri)
        found = {}
        for path, size in _files(self.uri):
            with system.open_input_file(path) as stream:
                end, head, before = settled(stream, size), _head(stream, size), self.known.get(path)
                floor, use = (before["end"], before["use"]) if before and self._same(stream, before, size) and before["end"] <= end else (0, None)
                found[path] = {"end": end, "size": size, "head": head, "use": _use_before(stream, end, floor) or use}
        self.known = found
        return found

    @staticmethod
    def _same(stream, before: dict, size: int) -> bool:
        """Whether a file is the one that an offset speaks of, perhaps longer now."""
        n, crc = before["head"]
        stream.seek(0)
        return size >= before["size"] and zlib.crc32(stream.read(n)) == crc

    def partitions(self, start, end):
        system, _ = filesystem(self.uri)
        out = []
        for number, (path, now) in enumerate(sorted(end.items())):
            before, high = None, now["end"]
            with system.open_input_file(path) as stream:
                for name in (path, *(p for p in sorted(start) if p != path)):
                    renamed = name != path and (name not in end or end[name]["head"] != start[name]["head"])
                    if name in start and (name == path or renamed) and start[name]["head"][0] and self._same(stream, start[name], now["size"]):
                        before = start[name]
                        break
            low, use = (before["end"], before["use"]) if before else (0, None)
            count = max(1, -(-(high - low) // self.split_bytes))
            if high > low:
                out += [_Range(self.uri, path, low + (high - low) * k // count, low + (high - low) * (k + 1) // count, (number << 32) + k, (low, high), use) for k in range(count)]
        return _tasks(out)

    def read(self, partition):
        return _batches(partition, self.classed)

    def commit(self, end):
        pass


class SlowLogSource(DataSource):
    """``spark.read.format("slowlog").option("splitBytes", n).load(path)``: a file, a folder or a pattern.

    ``option("fingerprints", "true")`` adds class id, fingerprint and kind of each statement where it is parsed, which
    saves the events a second way to Python and back.
    """

    @classmethod
    def name(cls):
        return "slowlog"

    def schema(self):
        return RAW + CLASSED * self._settings()[2]

    def _settings(self):
        return self.options["path"], int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT_BYTES))), self.options.get("fingerprints", "false") == "true"

    def reader(self, schema):
        return _Reader(*self._settings())

    def streamReader(self, schema):
        return _StreamReader(*self._settings())


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(SlowLogSource)


def _raw(spark: SparkSession, path: str, split_bytes: int, fingerprints: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("slowlog").option("splitBytes", str(split_bytes)).option("fingerprints", str(fingerprints).lower()).load(path)


def scan_slow_log(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, fingerprints: bool = False) -> DataFrame:
    """The source's rows, parsed once and kept in the shared folder, for ``resolved_events`` and ``counters``."""
    return stage(_raw(spark, path, split_bytes, fingerprints), "scan")


def resolved_events(raw: DataFrame, database: str = "") -> DataFrame:
    """Events with the database in force; ``database`` is the one before the first ``use``."""
    before = Window.partitionBy(F.shiftright("split", 32)).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = raw.where("kind = 'end'").select("split", F.coalesce(F.last("last_use", ignorenulls=True).over(before), F.lit(database)).alias("carried"))
    if raw.where("kind = 'end'").count() <= BROADCAST_RANGES:
        carried = F.broadcast(carried)
    events = raw.where("kind = 'event'").join(carried, "split", "left")
    names = [c.split()[0] for c in EVENT_COLUMNS.split(", ")]
    filled = {"database": F.coalesce("database", "carried", F.lit(database)), "seq": F.shiftleft(F.shiftright("split", 32), 44) + F.col("seq")}
    classed = [F.col("class_id"), F.col("fingerprint"), F.col("statement_kind").alias("kind")] if "class_id" in raw.columns else []
    return events.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in names), *classed)


def counters(raw: DataFrame) -> DataFrame:
    """One row: ``lines, events, skipped, splits``."""
    ends = raw.where("kind = 'end'")
    return ends.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "events", "skipped")), F.count(F.lit(1)).alias("splits"))


def read_slow_log(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, database: str = "") -> DataFrame:
    """Events of a log with the columns of ``EVENT_COLUMNS``; ``seq`` orders events as the files do.

    An empty log gives no events; a missing one raises.  The log is parsed once, when this is called.
    """
    return resolved_events(scan_slow_log(spark, path, split_bytes), database)


def log_counters(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row: ``lines, events, skipped, splits``."""
    return counters(_raw(spark, path, split_bytes))


def read_log_text(spark: SparkSession, text: str, database: str = "") -> DataFrame:
    """Events of a log that is already in memory."""
    from .records import parse_text

    rows = [tuple(_clean(v) if isinstance(v, str) else v for v in e) for e in parse_text(text, database).events]
    return spark.createDataFrame(rows, EVENT_COLUMNS)


def stream_slow_log(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Events of a growing log as a stream; a half-written event comes with the batch in which it is whole."""
    register(spark)
    raw = spark.readStream.format("slowlog").option("splitBytes", str(split_bytes)).load(path).where("kind = 'event'")
    return raw.select(*(c.split()[0] for c in EVENT_COLUMNS.split(", "))).withColumn("database", F.coalesce("database", F.lit("")))
