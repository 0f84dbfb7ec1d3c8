import functools
import io
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.encoding import PieceEncoder, _Known
from tidemark.llm.packing import CELLS, along_the_curve, hilbert_key, pack, powers_of_two, ranges_of
from tidemark.llm.sst import ShardReader, ShardWriter, id_of, key_of, look_up, read_token_shards, write_token_shards

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


library = functools.cache(Tokenizer.from_file)


def library_ids(path, text):
    return library(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_encode_as_the_library_does(path, as_text):
    fast, plain = PieceEncoder(path, special_as_text=as_text), Tokenizer.from_file(path)
    plain.encode_special_tokens = as_text
    assert fast.pattern is not None
    rng = random.Random(1)
    letters = [*"aZé ß.'!0912s tre\n\t\r\xa0 　́<|endoftext|>İσΣǅ中文😀_-\x1c\x85​", "<|endoftext|>", " <|startoftext|>", "<|endoftext"]
    for text in ["", " ", "  a  b ", "don't I'LL we've", "x" * 5000, "\n\n \n", "stop <|endoftext|> now", *("".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(1500))]:
        assert np.frombuffer(fast.encode(text), fast.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_encoder_remembers_a_bounded_number_of_bytes():
    known = _Known(lambda piece: piece.encode(), limit=100_000)
    for k in range(5000):
        assert known[f"piece{k}"] == f"piece{k}".encode()
        assert sum(sys.getsizeof(p) + len(v) for t in (known, known.old) for p, v in t.items()) < 100_000
    assert known["y" * 10_000] == b"y" * 10_000 and "y" * 10_000 not in known


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def whole_ids(path, text, end):
    return [*library_ids(path, text), end]


def test_shard_round_trip_and_lookup():
    rng = np.random.default_rng(0)
    want = {int(k): rng.integers(0, 49000, rng.integers(0, 300)).astype("<u2") for k in np.unique(rng.integers(-(10**12), 10**12, 700))}
    sink = io.BytesIO()
    writer = ShardWriter(sink, 2, block_bytes=4096)
    for k in sorted(want):
        writer.add(key_of(k), want[k].tobytes())
    with pytest.raises(ValueError, match="ascend"):
        writer.add(key_of(min(want)), b"")
    writer.close()
    reader = ShardReader(io.BytesIO(sink.getvalue()))
    assert len(reader.index) > 3 and reader.entries == len(want)
    assert [(k, v.tolist()) for k, v in reader.scan()] == [(k, want[k].tolist()) for k in sorted(want)]
    for k in want:
        assert [x.tolist() for x in reader.get(k)] == [want[k].tolist()]
    absent = [k + 1 for k in want if k + 1 not in want]
    assert all(reader.get(k) == [] for k in absent)
    assert sum(reader.may_hold(k) for k in absent) < len(absent) * 0.05
    damaged = bytearray(sink.getvalue())
    damaged[100] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(ShardReader(io.BytesIO(bytes(damaged))).scan())


def test_keys_keep_order():
    ids = [None, -(1 << 63), -5, 0, 7, (1 << 63) - 1]
    keys = [key_of(i) for i in ids]
    assert [id_of(k) for k in keys] == ids and keys[1:] == sorted(keys[1:])


def test_token_shards(spark, docs, rows_of):
    manifest = write_token_shards(docs, WORD, shard_bytes=30_000)
    assert manifest.count() > 4
    got = sorted((tuple(r) for r in read_token_shards(manifest).collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, t in sorted(rows_of, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole_ids(WORD, t or "", 1)
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    assert [x.tolist() for x in look_up(manifest, 8)] == [[*whole_ids(WORD, t, 1)] for _, t in sorted((r for r in rows_of if r[0] == 8), key=lambda r: r[1])]
    assert len(look_up(manifest, None)) == sum(i is None for i, _ in rows_of) and look_up(manifest, 99) == []


def test_token_shards_of_nothing(spark, empty):
    assert read_token_shards(write_token_shards(empty, WORD)).count() == 0


def test_hilbert_curve_visits_neighbours():
    bits, side = 3, 8
    points = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = hilbert_key(points, bits)
    assert sorted(keys.tolist()) == list(range(side**3))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_packing(docs, rows_of):
    rows = pack(docs, BYTE, length=64).collect()
    left = {}
    for i, t in rows_of:
        left.setdefault(i, []).append(whole_ids(BYTE, t or "", 0))
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.length and crc(ids) == r.ids_crc32
        assert any(len(d) == r.doc_tokens and d[r.start : r.start + r.length] == ids for d in left[r.doc_id])
    assert sum(r.length for r in rows) == sum(len(d) for ds in left.values() for d in ds)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64 and at & (at - 1) == 0


def test_packing_of_nothing(empty):
    assert pack(empty, BYTE).count() == 0
    assert powers_of_two(700) == [512, 128, 32, 16, 8, 4] and powers_of_two(0) == []


def test_packing_of_a_very_long_text(spark):
    text = " ".join(f"word{k % 9973}" for k in range(250_000))
    rows = pack(spark.createDataFrame([(1, text), (2, None), (2, None)], "doc_id long, text string"), BYTE, length=1024).collect()
    whole = whole_ids(BYTE, text, 0)
    long = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 1)
    assert [s for s, _, _ in long] == np.cumsum([0, *(n for _, n, _ in long)])[:-1].tolist() and sum(n for _, n, _ in long) == len(whole)
    assert all(crc(whole[s : s + n]) == c for s, n, c in long) and sum(r.doc_id == 2 for r in rows) == 2


def test_ranges_hold_about_equal_bytes(spark):
    assert ranges_of([(0, 4), (1, 5), (2, 3), (5, 40), (6, 1), (7, 9)], 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (5, 2, 4), (6, 6, 1), (7, 6, 1)]
    assert ranges_of([], 10) == [] and ranges_of([(3, 0)], 10) == [(3, 0, 1)]
    rng = np.random.default_rng(3)
    rows = [(k, None if k % 3 else k, int(c), int(b), b"x") for k, (c, b) in enumerate(zip(np.where(rng.random(4000) < 0.3, 7 << 40, rng.integers(0, 1 << 48, 4000)), rng.integers(1, 2000, 4000), strict=True))]
    table = spark.createDataFrame(rows, "row long, doc_id long, curve long, bytes long, ids binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed = along_the_curve(table).selectExpr("curve", "spark_partition_id() AS part").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(placed) == 4000
    ranges = {}
    for r in placed:
        ranges.setdefault(r.part, []).append(r.curve >> (48 - CELLS.bit_length() + 1))
    assert all(c == sorted(c) for c in ranges.values())  # along the curve within a range, and from range to range
    ordered = [ranges[p] for p in sorted(ranges)]
    assert all(a[-1] <= b[0] for a, b in zip(ordered, ordered[1:], strict=False)) and max(map(len, ordered)) < 500
