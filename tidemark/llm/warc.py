"""WARC archives written from, and read into, chunked record tables.

A payload is a series of rows (record, chunk number, bytes), cut where the table is scanned: each row of the series
takes its own part of the payload, so beyond the input's own row no whole payload is copied, shuffled or sorted.  The
rows of a record, and before them one row with its header, meet in one partition in the order of the chunks.  The
writer copies chunk after chunk into the archive and the reader emits chunk after chunk from it; both keep only an
incremental SHA-1, so their memory is bounded by a chunk and not by a record.  The writer fails if the digest of what
it streamed differs from the one that was promised in the record's header; the reader carries the digest of all bytes
so far in each chunk row.

Records with equal payloads of at least ``min_revisit_bytes`` are written once: the one with the largest identifier is
the response and the others are revisit records that refer to it.  A payload that a third of all rows share is settled
over ``leaves``, dealt by the rows' places, so no task sees all of them.  A task names its files by attempt; only files
in the manifest count.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ROW, new_folder, open_filesystem, ship, shuffle_width, stage, with_rows

CHUNK = 1 << 16
#: Fixed values of the WARC/1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"


def record_urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "null" else int(name)


def _field(text: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "")


def head_of(page_id, url, digest, size, kind, refers_to) -> bytes:
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_field(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}"]
    lines.append(f"Content-Length: {len(HTTP_HEAD) + (size if kind == 'response' else 0)}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"


class _Member:
    """One gzip member of an output stream, or the bytes as they are."""

    def __init__(self, sink, compress: bool):
        self.sink, self.z, self.n = sink, zlib.compressobj(1, zlib.DEFLATED, 31) if compress else None, 0

    def write(self, data: bytes) -> None:
        data = self.z.compress(data) if self.z else data
        self.n += len(data)
        self.sink.write(data)

    def close(self) -> None:
        if self.z:
            rest = self.z.flush()
            self.n += len(rest)
            self.sink.write(rest)


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0, leaves: int | None = None) -> DataFrame:
    """``ROW, page_id, url, sha1, size, revisit, refers_to`` of each row of ``pages (ROW, page_id, url, payload)``."""
    leaves = leaves or 1 << max(2, (shuffle_width(pages.sparkSession) - 1).bit_length())
    known = stage(
        pages.select(*ROW, "page_id", "url", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"), F.pmod(F.xxhash64(*ROW), F.lit(leaves)).alias("leaf")),
        "digests",
    )
    best = F.struct(F.col("page_id").isNotNull().alias("named"), F.col("page_id").alias("id"), *ROW)
    leaf = known.where(F.col("size") >= min_revisit_bytes).groupBy("leaf", "sha1", "size").agg(F.max(best).alias("best"))
    top = leaf.groupBy("sha1", "size").agg(F.max("best").alias("first"))
    first = leaf.select("leaf", "sha1", "size").join(top, ["sha1", "size"])
    revisit = F.coalesce(~((F.col(f"first.{ROW[0]}") == F.col(ROW[0])) & (F.col(f"first.{ROW[1]}") == F.col(ROW[1]))), F.lit(False))
    return known.join(first, ["leaf", "sha1", "size"], "left").select(*ROW, "page_id", "url", "sha1", "size", revisit.alias("revisit"), F.when(revisit, F.col("first.id")).alias("refers_to"))


def chunk_rows(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (…, chunk_no, data) instead of ``payload``, each cut by itself; an empty payload has one empty chunk."""
    last = F.greatest(F.ceil((F.octet_length("payload") / F.lit(chunk))).cast("int") - 1, F.lit(0))
    rest = [c for c in pages.columns if c != "payload"]
    numbered = pages.select(*rest, "payload", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return numbered.select(*rest, "chunk_no", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"))


def write_warc(
    pages: DataFrame,
    out_uri: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
    file_bytes: int = 1 << 28,
    compress: bool = True,
) -> DataFrame:
    """Write one record per row below ``out_uri`` (a shared folder) and return the manifest ``path, records, bytes``.

    The payload is the text in UTF-8; null is empty.  Of rows that repeat the largest identifier of a payload the last
    by file and place is the response; rows without an identifier are responses only where no row with the payload has
    one.  A null identifier or URL is written as such.  Identifiers are whole numbers, or what a cast to long accepts.
    An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = out_uri or new_folder(spark, "warc")
    rows = with_rows(pages).select(*ROW, F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    plan = plan_records(rows, min_revisit_bytes)
    heads = plan.select(*ROW, F.lit(-1).alias("chunk_no"), F.struct("page_id", "url", "sha1", "size", "revisit", "refers_to").alias("head"), F.lit(None).cast("binary").alias("data"))
    chunks = chunk_rows(rows.select(*ROW, "payload")).select(*ROW, "chunk_no", F.lit(None).cast(heads.schema["head"].dataType).alias("head"), "data")
    ordered = heads.unionByName(chunks).repartition(*ROW).sortWithinPartitions(*ROW, "chunk_no").select("chunk_no", "head.*", "data")

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, base = open_filesystem(folder)
        done, sink, member, path, records, written = [], None, None, "", 0, 0
        digest, promised, number = None, "", 0

        def end_record():
            nonlocal written
            if digest is not None and base64.b32encode(digest.digest()).decode() != promised:
                raise ValueError(f"the payload written to {path} has another digest than announced")
            member.write(b"\r\n\r\n")
            member.close()
            written += member.n

        for batch in batches:
            cols = [batch.column(k) for k in range(batch.num_columns)]
            for k in range(batch.num_rows):
                chunk, page, url, sha1, size, revisit, refers, data = (c[k] for c in cols)
                if chunk.as_py() < 0:
                    if member is not None:
                        end_record()
                        member = None
                        if written >= file_bytes:
                            sink.close()
                            done.append((path, records, written))
                            sink, number = None, number + 1
                    if sink is None:
                        fs.create_dir(base, recursive=True)
                        name = f"part-{TaskContext.get().partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.warc" + ".gz" * compress
                        path, records, written = f"{folder}/{name}", 0, 0
                        sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                    promised = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                    kind = "revisit" if revisit.as_py() else "response"
                    member, records = _Member(sink, compress), records + 1
                    member.write(head_of(page.as_py(), url.as_py(), promised, size.as_py(), kind, refers.as_py()) + HTTP_HEAD)
                    digest = hashlib.sha1() if kind == "response" else None
                elif digest is not None:
                    digest.update(data.as_buffer())
                    member.write(data.as_buffer())
        if member is not None:
            end_record()
        if sink is not None:
            sink.close()
            done.append((path, records, written))
        cols = list(zip(*done, strict=True)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return stage(ordered.mapInArrow(work, "path string, records long, bytes long"), "manifest")


class _Bytes:
    """Buffered bytes of an archive, gzip members joined."""

    def __init__(self, source, compressed: bool, step: int = CHUNK):
        self.source, self.step = source, step
        self.z = zlib.decompressobj(31) if compressed else None
        self.compressed, self.raw, self.held = compressed, b"", b""

    def _more(self) -> bool:
        if not self.compressed:
            got = self.source.read(self.step)
            self.held += got
            return bool(got)
        while True:
            if not self.raw:
                self.raw = self.source.read(self.step)
                if not self.raw:
                    return False
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.raw, self.step)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.held += got
                return True

    def take(self, n: int) -> bytes:
        """Up to ``n`` bytes, fewer only at the end."""
        while len(self.held) < n and self._more():
            pass
        got, self.held = self.held[:n], self.held[n:]
        return got

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                return None
        got, self.held = self.held[:at], self.held[at + len(mark) :]
        return got


def records_of(source, compressed: bool, chunk: int = CHUNK):
    """(header fields, chunk number, bytes, digest so far, bytes so far, last) for each chunk of each record."""
    data = _Bytes(source, compressed)
    while (head := data.until(b"\r\n\r\n")) is not None:
        lines = head.strip(b"\r\n").split(b"\r\n")
        if lines[0] != VERSION:
            raise ValueError("not a WARC record")
        fields = dict(x.decode().split(": ", 1) if ": " in x.decode() else (x.decode().rstrip(":"), "") for x in lines[1:])
        left = int(fields["Content-Length"])
        http = data.until(b"\r\n\r\n")
        left -= len(http) + 4
        digest, number, seen = hashlib.sha1(), 0, 0
        while True:
            part = data.take(min(chunk, left))
            if len(part) < min(chunk, left):
                raise ValueError("the archive ends early")
            digest.update(part)
            left -= len(part)
            seen += len(part)
            yield fields, number, part, base64.b32encode(digest.digest()).decode(), seen, left == 0
            if not left:
                break
            number += 1
        if data.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")


RECORDS = "page_id long, url string, record_type string, refers_to long, chunk_no int, chunk_bytes long, bytes_so_far long, digest_so_far string, last boolean, payload_digest string, payload_bytes long, data binary"


def read_warc(spark: SparkSession, manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """Chunk rows of every record in the manifest's archives; ``data`` is null with ``with_data=False``.

    ``payload_digest`` and ``payload_bytes`` are the header's statement about the full payload; for a response the last
    chunk's running digest and count must agree with it, else the task fails.
    """
    ship(spark)

    def work(batches):
        import pyarrow as pa

        names, kinds = zip(*(x.split() for x in RECORDS.split(", ")), strict=True)
        of = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_filesystem(path)
                with fs.open_input_stream(at, compression=None) as source:
                    rows, size = [], 0
                    for head, number, part, digest, seen, last in records_of(source, path.endswith(".gz")):
                        kind, full = head["WARC-Type"], int(head["X-Payload-Length"])
                        said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and last and (digest, seen) != (said, full):
                            raise ValueError(f"a payload in {path} differs from its header")
                        refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((page_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, refers, number, len(part), seen, digest, last, said, full, part if with_data else None))
                        size += len(part) if with_data else 200
                        if len(rows) >= 4096 or size >= 1 << 24:
                            yield table(rows)
                            rows, size = [], 0
                    if rows:
                        yield table(rows)

    return manifest.select("path").repartition(shuffle_width(spark)).mapInArrow(work, RECORDS)
