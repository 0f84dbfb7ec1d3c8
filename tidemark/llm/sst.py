"""Token-id shards as sorted string tables.

A shard holds documents in ascending identifier order:

    data block *          prefix-compressed entries, restart array, CRC-32
    sparse index          last key, offset and length of every block
    Bloom filter          double hashing over one XXH64 of a key
    footer (fixed size)   places of index and filter, counts, id width, magic

A key is the identifier as eight bytes whose order is the identifiers' order (none for a null identifier), followed by
a four-byte number that tells rows with the same identifier apart.  An entry stores how many bytes its key shares with
the one before it; at every ``RESTART``-th entry the key is whole, so a reader can start there.  A lookup asks the
filter, finds the block by binary search in the index, the restart by binary search in the block, and scans at most
``RESTART`` entries.  Readers fetch single blocks, so memory is bounded by the largest document plus a block.

A writing task names its files by attempt, lists its shards in a manifest file of its own and reports that file; only
the files reported by tasks that succeeded count, so a lost or repeated task leaves no half-written shard behind.  The
driver gets one narrow row per task, from which it knows where each task's ids start.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .encoding import crc32_of_ids, encoder
from .shared import new_folder, open_filesystem, ship, shuffle_width

MAGIC = b"TMSST01\n"
RESTART = 16
FOOTER = struct.Struct("<QQQQQQII8s")  # index offset, length, filter offset, length, entries, ids, id width, hashes, magic
_U32 = struct.Struct("<I")


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    head = b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))
    return head + struct.pack(">I", repeat)


def id_of(key: bytes) -> int | None:
    return None if len(key) == 4 else struct.unpack(">Q", key[:8])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def _positions(doc_id: int | None, bits: int, hashes: int) -> list[int]:
    h = xxh64_intdigest(key_of(doc_id)[:-4], 7)
    step = (h >> 32) | 1
    return [(h + k * step) % bits for k in range(hashes)]


class ShardWriter:
    """Writes one shard to an open binary stream; keys must ascend."""

    def __init__(self, sink, id_width: int, block_bytes: int = 1 << 16):
        self.sink, self.id_width, self.block_bytes = sink, id_width, block_bytes
        self.at = self.entries = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.names: list[int | None] = []
        self.last = b""
        self._start()

    def _start(self) -> None:
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.entries and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.block))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last = key
        self.in_block += 1
        self.entries += 1
        self.ids += len(ids) // self.id_width
        if not self.names or self.names[-1] != id_of(key):
            self.names.append(id_of(key))
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.in_block:
            body = bytes(self.block) + b"".join(map(_U32.pack, self.restarts)) + _U32.pack(len(self.restarts))
            self.index.append((self.last, *self._put(body + _U32.pack(zlib.crc32(body)))))
            self._start()

    def close(self) -> None:
        self._flush()
        index = self._put(b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index))
        bits, hashes = max(64, 10 * len(self.names)), 7
        bloom = np.zeros(bits, np.uint8)
        for name in self.names:
            bloom[_positions(name, bits, hashes)] = 1
        held = self._put(_U32.pack(bits) + np.packbits(bloom).tobytes())
        self._put(FOOTER.pack(*index, *held, self.entries, self.ids, self.id_width, hashes, MAGIC))


class ShardReader:
    """Reads a shard from a seekable binary stream, block by block."""

    def __init__(self, source):
        self.source = source
        source.seek(0, io.SEEK_END)
        size = source.tell()
        *places, self.entries, self.n_ids, self.id_width, self.hashes, magic = FOOTER.unpack(self._fetch(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.dtype = np.dtype(f"<u{self.id_width}")
        raw, at, self.index = self._fetch(places[0], places[1]), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            self.index.append((key, offset, length))
        self.lasts = [x[0] for x in self.index]
        held = self._fetch(places[2], places[3])
        self.bits, self.bloom = _U32.unpack(held[:4])[0], held[4:]

    def _fetch(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        data = self.source.read(length)
        if len(data) != length:
            raise ValueError("the shard ends early")
        return data

    def _block(self, n: int) -> tuple[bytes, list[int], int]:
        raw = self._fetch(*self.index[n][1:])
        if zlib.crc32(raw[:-4]) != _U32.unpack(raw[-4:])[0]:
            raise ValueError("a block is damaged")
        count = _U32.unpack(raw[-8:-4])[0]
        end = len(raw) - 8 - 4 * count
        return raw, list(struct.unpack(f"<{count}I", raw[end:-8])), end

    def _entries(self, raw: bytes, at: int, end: int):
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, np.frombuffer(raw, self.dtype, size // self.id_width, at)
            at += size

    def scan(self):
        """(identifier, ids) of every document in order."""
        for n in range(len(self.index)):
            raw, _, end = self._block(n)
            for key, ids in self._entries(raw, 0, end):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _positions(doc_id, self.bits, self.hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of the documents with this identifier; none if it is absent."""
        if not self.may_hold(doc_id):
            return []
        low, found = key_of(doc_id), []
        for n in range(bisect_left(self.lasts, low), len(self.index)):
            raw, restarts, end = self._block(n)
            a, b = 0, len(restarts)
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if next(self._entries(raw, restarts[mid], end))[0] <= low else (a, mid)
            for key, ids in self._entries(raw, restarts[a], end):
                if id_of(key) == doc_id:
                    found.append(ids)
                elif key > low:
                    return found
        return found


SHARDS = "part int, shard int, path string, n_docs long, n_tokens long, bytes long, first_id long, last_id long"
MANIFEST = SHARDS + ", start long"
_TASK = "part int, path string, n_shards long, n_tokens long, bytes long"


def _schema(ddl: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def write_token_shards(
    docs: DataFrame,
    tokenizer_path: str,
    out_uri: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 1,
    shard_bytes: int = 64 << 20,
    special_as_text: bool = False,
) -> DataFrame:
    """Encode every text and write shards below ``out_uri`` (a shared folder); returns the manifest.

    The manifest has a row per shard: ``part, shard, path, n_docs, n_tokens, bytes, first_id, last_id`` and
    ``start``, the ids in all shards before it.  Shards ascend by (part, shard), and so do identifiers through them;
    null identifiers come first and rows with the same identifier in the order of their texts.  Identifiers are whole
    numbers, or what a cast to long accepts.  ``end_id`` is appended to each document.  Null text is empty; an empty
    table gives an empty manifest.  The files are written at once, not when the manifest is read.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = out_uri or new_folder(spark, "tokens")

    def work(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, special_as_text)
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        fs, base = open_filesystem(folder)
        part, number, rows = TaskContext.get().partitionId(), 0, []
        writer = sink = path = None
        first = last = None
        repeat = 0

        def finish():
            writer.close()
            sink.close()
            rows.append((part, number, path, writer.entries, writer.ids, writer.at, first, last))

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc = doc.as_py()
                if writer is not None and writer.at + len(writer.block) >= shard_bytes and doc != last:
                    finish()
                    writer, number = None, number + 1
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.sst"
                    path = f"{folder}/{name}"
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                    writer, first, last, repeat = ShardWriter(sink, enc.dtype.itemsize), doc, doc, -1
                repeat = repeat + 1 if doc == last else 0
                last = doc
                writer.add(key_of(doc, repeat), enc.encode(text.as_py()) + tail)
        if writer is None:
            return
        finish()
        name = f"manifest-{part:06d}-{uuid.uuid4().hex}.parquet"
        columns = list(zip(*rows, strict=True))
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            pq.write_table(pa.table(columns, schema=_schema(SHARDS)), out)
        yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name}", "n_shards": len(rows), "n_tokens": sum(columns[4]), "bytes": sum(columns[5])}], _schema(_TASK))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tasks = sorted(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(work, _TASK).collect())  # a row per task
    starts, at = [], 0
    for t in tasks:
        starts.append((t.path, at))
        at += t.n_tokens

    def listed(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, own = open_filesystem(path)
                with fs.open_input_file(own) as source:
                    shards = pq.read_table(source)
                before = np.cumsum([start, *shards.column("n_tokens").to_pylist()])[:-1]
                yield from shards.append_column("start", pa.array(before, pa.int64())).to_batches()

    width = max(1, min(shuffle_width(spark), len(tasks), -(-sum(t.bytes for t in tasks) // READ_BYTES)))
    return spark.createDataFrame(starts, "path string, start long").repartition(width).mapInArrow(listed, MANIFEST)


#: Bytes of shards that one task reads, if there are so many.
READ_BYTES = 4 << 20


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files of a manifest."""
    ship(manifest.sparkSession)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def work(batches):
        import pyarrow as pa

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = open_filesystem(path)
                out: list[tuple] = []
                with fs.open_input_file(at) as source:
                    for doc, ids in ShardReader(source).scan():
                        out.append((doc, start, len(ids), crc32_of_ids(ids)))
                        start += len(ids)
                        if len(out) >= 4096:
                            yield table(out)
                            out = []
                if out:
                    yield table(out)

    return manifest.select("path", "start").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def look_up(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """Ids of the documents with this identifier, from the shards whose range of identifiers holds it."""
    own = manifest.where(F.col("first_id").isNull() if doc_id is None else (F.coalesce("first_id", F.lit(-(1 << 63))) <= doc_id) & (F.col("last_id") >= doc_id))
    found = []
    for row in own.select("path").toLocalIterator():
        fs, at = open_filesystem(row.path)
        with fs.open_input_file(at) as source:
            found += ShardReader(source).get(doc_id)
    return found
