"""Packing along a space-filling curve.

Each document becomes a hashed bag of its token ids, which a fixed Gaussian matrix projects to a few dimensions.  The
projections, cut to a grid, give a position on a Hilbert curve, so documents close on the curve have similar
vocabularies.  The curve is cut into ranges of about equal bytes: the bytes of its ``CELLS`` equal stretches are summed
up, light ones are joined and a heavy one, such as that of many copies, is dealt over several ranges by row.  The table
is sorted by (curve position, identifier) within each range.  Each range is then one pass that lays the documents end to end and cuts
every ``length`` ids.  Only a range's last sequence is short; it is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import crc32_of_ids, encoder
from .shared import ship, shuffle_width, stage

BINS, DIMS, BITS = 512, 4, 12
RANGE_BYTES = 64 << 20  # of ids that one task packs, about
CELLS = 1 << 14


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows of ``cells``, each below 2**bits), by Skilling's transposition.

    J. Skilling, "Programming the Hilbert curve", AIP Conference Proceedings 707 (2004).
    """
    x = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for k in range(len(x)):
            on = (x[k] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[-1] & (1 << level)) != 0, flip ^ ((1 << level) - 1), flip)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> level) & 1)
    return key


def _plane(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BINS, DIMS))


def curve_position(ids: list[np.ndarray], plane: np.ndarray) -> np.ndarray:
    """Curve positions of documents given as id arrays; a document without ids lies at the projections' origin."""
    bags = np.zeros((len(ids), BINS))
    for k, x in enumerate(ids):
        bags[k] = np.bincount((x.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)).astype(np.int64) % BINS, minlength=BINS)
    bags = np.sqrt(bags)
    bags /= np.maximum(np.linalg.norm(bags, axis=1, keepdims=True), 1e-12)
    cells = np.clip(((bags @ plane) / 8 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells, BITS)


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, seed: int = 11) -> DataFrame:
    """``row, doc_id, curve, bytes, ids`` of every row; ids are little-endian bytes with the end id at the end."""
    ship(docs.sparkSession)

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, plane = encoder(tokenizer_path), _plane(seed)
        tail, row = np.array([end_id], enc.dtype).tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [enc.encode(x.as_py()) for x in part.column(1)]
                where = curve_position([np.frombuffer(r, enc.dtype) for r in raw], plane)
                sizes = [len(r) + len(tail) for r in raw]
                names = np.arange(row, row + len(raw))
                row += len(raw)
                columns = [pa.array(names, pa.int64()), part.column(0), pa.array(where, pa.int64()), pa.array(sizes, pa.int64()), pa.array([r + tail for r in raw], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "curve", "bytes", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "row long, doc_id long, curve long, bytes long, ids binary")


def ranges_of(cells: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """``cell, first range, ranges`` for each (cell, bytes) in order; a range holds about ``most`` bytes."""
    out, number, used = [], 0, 0
    for cell, size in cells:
        parts = max(1, round(size / most))
        if used and (parts > 1 or used + size > most):
            number, used = number + 1, 0
        out.append((cell, number, parts))
        if parts > 1:
            number += parts
        else:
            used += size
    return out


def along_the_curve(table: DataFrame) -> DataFrame:
    """A tokenised table in ranges of the curve, each in one partition and sorted."""
    spark = table.sparkSession
    cell = F.shiftright("curve", DIMS * BITS - CELLS.bit_length() + 1)
    sizes = sorted(tuple(r) for r in table.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes")).collect())  # CELLS rows at most
    most = max(1, min(RANGE_BYTES, -(-sum(s for _, s in sizes) // shuffle_width(spark))))
    ranges = ranges_of(sizes, most)
    count = max((first + parts for _, first, parts in ranges), default=1)
    where = spark.createDataFrame(ranges, "cell long, first long, parts long")
    placed = table.withColumn("cell", cell).join(F.broadcast(where), "cell")
    number = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))
    return placed.select("doc_id", "curve", "ids", number.cast("int").alias("range")).repartitionById(count, F.col("range")).sortWithinPartitions("curve", "doc_id")


def powers_of_two(n: int) -> list[int]:
    """Powers of two that sum to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    A document's ids, its end id included, lie in consecutive pieces, each id in one.  Pieces of a sequence follow one
    another from offset 0.  A sequence has ``length`` ids or a power of two of them.  Null text is empty and packs as
    its end id alone.  A repeated row is packed again.  ``ids`` (the piece's ids as the encoder's little-endian
    integers) is null with ``with_ids=False``.  An empty table gives an empty result.  Identifiers are whole numbers, or
    what a cast to long accepts.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    ship(docs.sparkSession)

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        dtype = encoder(tokenizer_path).dtype
        number, rows, held, used = TaskContext.get().partitionId() << 40, [], [], 0

        def put(doc, start, ids, whole, offset):
            rows.append((doc, start, len(ids), crc32_of_ids(ids), whole, number, offset, ids.tobytes() if with_ids else None))

        def batch_of():
            out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:-1]), pa.array([r[-1] for r in rows], pa.binary())], [x.split()[0] for x in PIECES.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, at = np.frombuffer(raw.as_buffer(), dtype), 0
                while at < len(ids):
                    piece = ids[at : at + length - used]
                    held.append((doc, at, piece, len(ids), used))
                    at += len(piece)
                    used += len(piece)
                    if used == length:
                        for x in held:
                            put(*x)
                        held, used, number = [], 0, number + 1
                if len(rows) >= 8192:
                    yield batch_of()
        sizes = powers_of_two(used)
        offset = 0
        for doc, start, ids, whole, _ in held:
            while len(ids):
                now = ids[: sizes[0] - offset]
                put(doc, start, now, whole, offset)
                start, ids, offset = start + len(now), ids[len(now) :], offset + len(now)
                if offset == sizes[0]:
                    sizes, offset, number = sizes[1:], 0, number + 1
        if rows:
            yield batch_of()

    table = stage(tokenised(docs, tokenizer_path, id_col, text_col, end_id), "tokenised")
    return along_the_curve(table).select("doc_id", "ids").mapInArrow(work, PIECES)
