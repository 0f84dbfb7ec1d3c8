"""Near-duplicate groups by SimHash fingerprints, pigeonhole blocks and verified Hamming distance.

1. Fingerprints: for each text, XXH64 of every word shingle (repeats included); a bit of the 64-bit fingerprint is 1
   if it is set in more than half of the hashes.
2. Equal fingerprints form one class, named by the fingerprint, so copies are never paired up.
3. Pigeonhole: the 64 bits are cut into ``blocks`` blocks.  Two fingerprints that differ in at most ``distance`` bits
   agree in at least ``blocks - distance`` of them, so each class is filed once under every choice of that many
   blocks, and every close pair shares a bucket.
4. In a bucket every pair is verified by its Hamming distance; only a spanning forest of the links is emitted.
5. A bucket of more than ``bucket_limit`` classes is not held in memory.  Its members go on as rows and are linked
   exactly by midpoints: two fingerprints lie within ``distance`` of each other if and only if some value lies within
   half of it of both.  Every member lists its half-radius ball and all that list a value link to the smallest of
   them.  That costs rows in proportion to the members, in as many tasks as there are values.
6. Connected components over the links.

``blocks=None`` picks the number of blocks from the number of classes, so that a bucket of unrelated fingerprints
stays small: 6 up to 2**26 classes, 7 up to 2**32, 8 beyond.  Every choice finds the same links.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import ROW, only_rows, ship, stage, with_rows

#: ASCII capitals to small letters.
LOWER_ASCII = {c: c + 32 for c in range(65, 91)}
SMALL_BUCKET = 16


def text_fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text; zero for a text without words."""
    import re

    import numpy as np
    from xxhash import xxh64_intdigest

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER_ASCII).encode("utf-8", "surrogatepass"))
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        begins = [0, *(e + 1 for e in ends[: len(words) - shingle])]
        hashes = [xxh64_intdigest(line[a:b], seed) for a, b in zip(begins, ends[shingle - 1 :], strict=True)]
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = np.array(hashes[k : k + 65536], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fp`` (fingerprint as a signed long) and the long columns ``carried``, one row per input row; null text has no words."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType()), *(T.StructField(c, T.LongType()) for c in carried)])

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            found = (text_fingerprint(x.as_py(), shingle) for x in batch.column(1))
            signed = [x - (1 << 64) if x >> 63 else x for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed, pa.int64()), *batch.columns[2:]], schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried).mapInArrow(work, schema)


def _bounds(blocks: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each block."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def bucket_keys(fp: Column, distance: int, blocks: int) -> Column:
    """Array of (choice of blocks, their masked bits), one for each choice that a close pair may share."""
    keys = []
    for chosen in combinations(_bounds(blocks), blocks - distance):
        mask = sum(((1 << w) - 1) << low for low, w in chosen)
        keys.append(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return F.array(*(F.struct(F.lit(i).cast("int").alias("choice"), k.alias("bits")) for i, k in enumerate(keys)))


def _forest(fps, distance):
    """Edges (member, least of its group) of the groups linked within one bucket, by search from each member."""
    import numpy as np

    ids = fps.view(np.int64)
    left = np.arange(len(fps))
    us, vs = [], []
    while len(left):
        group, front, left = [left[0]], [left[0]], left[1:]
        while front and len(left):
            close = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= distance
            if close.any():
                new = left[close]
                left = left[~close]
                group.extend(new)
                front.extend(new)
        if len(group) > 1:
            names = ids[group]
            least = names.min()
            us.append(names[names != least])
            vs.append(np.full(len(us[-1]), least))
    return us, vs


def _link(distance: int, limit: int):
    """Arrow batches (choice, bits, fp), sorted by bucket, to rows (kind, u, v): links 0, members of full buckets 1 (as u)."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def emit(kind, us, vs):
            u, v = np.concatenate(us), np.concatenate(vs)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int8)), pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], ["kind", "u", "v"])

        def whole(ids, starts, ends):
            """All buckets [starts, ends) of these rows."""
            fps, sizes = ids.view(np.uint64), ends - starts
            us, vs = [], []
            small = np.zeros(len(fps), np.int64)
            for a, b in zip(starts[sizes > SMALL_BUCKET], ends[sizes > SMALL_BUCKET], strict=True):
                u, v = _forest(fps[a:b], distance)
                us += u
                vs += v
            keep = (sizes > 1) & (sizes <= SMALL_BUCKET)
            rest = np.concatenate([np.arange(a, b) for a, b in zip(starts[keep], ends[keep], strict=True)]) if keep.any() else small[:0]
            after = np.repeat(ends[keep], sizes[keep])
            for lag in range(1, SMALL_BUCKET):
                on = rest + lag < after
                rest, after = rest[on], after[on]
                if not len(rest):
                    break
                hit = rest[np.bitwise_count(fps[rest] ^ fps[rest + lag]) <= distance]
                if len(hit):
                    us.append(np.maximum(ids[hit], ids[hit + lag]))
                    vs.append(np.minimum(ids[hit], ids[hit + lag]))
            return us, vs

        held, full = None, None  # rows of the last bucket so far; the bucket whose members only pass through
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if full is not None:
                same = (now[0] == full[0]) & (now[1] == full[1])
                if same.any():
                    yield emit(1, [now[2][same]], [now[2][same]])
                    now = [x[~same] for x in now]
                if len(now[0]):
                    full = None
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            new = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            starts = np.concatenate([[0], new])
            ends = np.concatenate([new, [len(now[0])]])
            sizes = ends - starts
            for a, b in zip(starts[:-1][sizes[:-1] > limit], ends[:-1][sizes[:-1] > limit], strict=True):
                yield emit(1, [now[2][a:b]], [now[2][a:b]])
            fit = np.flatnonzero(sizes[:-1] <= limit)
            us, vs = whole(now[2], starts[fit], ends[fit])
            if us:
                yield emit(0, us, vs)
            last = int(starts[-1])
            held = [x[last:].copy() for x in now]
            if len(held[0]) > limit:
                yield emit(1, [held[2]], [held[2]])
                full, held = (held[0][0], held[1][0]), None
        if held is not None and len(held[0]) > 1:
            us, vs = _forest(held[2].view(np.uint64), distance)
            if us:
                yield emit(0, us, vs)

    return work


def _by_midpoints(members: DataFrame, distance: int) -> DataFrame:
    """Links (u, v) among the members (u) of overfull buckets."""
    radius = -(-distance // 2)
    masks = [reduce(lambda m, b: m | 1 << b, bits, 0) for r in range(radius + 1) for bits in combinations(range(64), r)]
    ball = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
    if distance % 2:
        raise ValueError("overfull buckets need an even distance")
    spread = members.select("u").distinct().select("u", F.explode(F.transform(ball, lambda m: F.col("u").bitwiseXOR(m))).alias("mid"))
    least = spread.groupBy("mid").agg(F.min("u").alias("least"))
    return spread.join(least, "mid").where("u <> least").select("u", F.col("least").alias("v")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id, fp`` (signed long), ``stays``.

    ``component_id`` is the smallest identifier that can be reached over links, null if no member has one.  Null or
    blank text has the fingerprint zero and is linked like any other; so are rows without an identifier.  Rows that
    repeat an identifier each keep their own fingerprint.  ``stays`` is true for exactly one row of each group: the
    smallest identifier, and of rows that repeat it the first by file and place.  Identifiers are whole numbers, or
    what a cast to long accepts.  An empty table gives an empty result.  ``options`` are those of ``grouped_rows``.
    """
    return grouped_rows(with_rows(docs), id_col, text_col, **options).drop(*ROW)


def grouped_rows(rows: DataFrame, id_col: str, text_col: str, shingle: int = 4, distance: int = 4, blocks: int | None = None, bucket_limit: int = 16384) -> DataFrame:
    """``near_groups`` of rows that have their ``ROW`` columns, with these columns."""
    texts = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *ROW)
    prints = stage(fingerprints(texts, "doc_id", "text", shingle, carried=ROW), "prints")
    best = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), *ROW)
    classes = stage(prints.groupBy("fp").agg(F.min(best).alias("best")), "classes")
    if blocks is None:
        n = classes.count()
        blocks = distance + (2 if n <= 1 << 26 else 3 if n <= 1 << 32 else 4)
    filed = classes.select("fp", F.explode(bucket_keys(F.col("fp"), distance, blocks)).alias("k")).select("k.choice", "k.bits", "fp")
    linked = stage(
        filed.repartition("choice", "bits").sortWithinPartitions("choice", "bits").mapInArrow(_link(distance, bucket_limit), "kind byte, u long, v long"),
        "links",
    )
    edges = linked.where("kind = 0").select("u", "v")
    crowd = linked.where("kind = 1").select("u")
    if not crowd.isEmpty():
        edges = edges.union(_by_midpoints(crowd, distance))
    groups = components(edges)
    linked_to = classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "best", F.coalesce("component", "fp").alias("label"))
    winners = linked_to.groupBy("label").agg(F.min("best").alias("winner"))
    of_class = linked_to.join(winners, "label").select("fp", "winner")
    return prints.join(of_class, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("winner.id").alias("component_id"),
        "fp",
        ((F.col(ROW[0]) == F.col(f"winner.{ROW[0]}")) & (F.col(ROW[1]) == F.col(f"winner.{ROW[1]}"))).alias("stays"),
        *ROW,
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, one of each group, with all their columns; see ``near_groups``.

    Rows are told apart by their place, so null and repeated identifiers and repeated rows do not keep a copy in.
    """
    keyed = with_rows(docs)
    return only_rows(keyed, grouped_rows(keyed, id_col, text_col, **options).where("stays"), docs.columns)
