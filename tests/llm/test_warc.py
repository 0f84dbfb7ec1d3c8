import base64
import hashlib
import io

from tidemark.llm.warc import chunk_rows, read_warc, records_of, write_warc

PAGES = "page_id long, url string, html string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages(spark):
    big = "<p>long é</p>" * 30_000
    rows = [(1, "http://a", "<a>"), (2, "http://b\r\nX: y", None), (3, None, ""), (4, "u", "<a>"), (5, "u", big), (9, "u", big), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "é")]
    return spark.createDataFrame(rows, PAGES)


def test_round_trip(spark):
    frame = pages(spark)
    html = {r.page_id: (r.html or "").encode() for r in frame.collect()}
    for compress in (True, False):
        records = read_warc(spark, write_warc(frame, compress=compress, file_bytes=1000)).collect()
        by_page = {}
        for r in sorted(records, key=lambda r: r.chunk_no):
            by_page.setdefault(r.page_id, []).append(r)
        assert set(by_page) == set(html)
        for page, chunks in by_page.items():
            keeper = max(k for k in html if html[k] == html[page])
            last = chunks[-1]
            assert last.last and (last.payload_digest, last.payload_bytes) == (digest(html[page]), len(html[page]))
            if page == keeper:
                assert (last.record_type, last.refers_to) == ("response", None)
                assert b"".join(c.data for c in chunks) == html[page]
                assert max(len(c.data) for c in chunks) <= 1 << 16
                seen = b""
                for c in chunks:
                    seen += c.data
                    assert (c.digest_so_far, c.bytes_so_far) == (digest(seen), len(seen))
            else:
                assert (last.record_type, last.refers_to, last.data) == ("revisit", keeper, b"")


def test_small_payloads_can_be_exempt(spark):
    rows = {r.page_id: r.record_type for r in read_warc(spark, write_warc(pages(spark), min_revisit_bytes=10)).where("last").collect()}
    assert rows[1] == rows[4] == rows[2] == rows[3] == "response" and (rows[5], rows[9]) == ("revisit", "response")


def test_nothing_and_extra_columns(spark):
    from pyspark.sql import functions as F

    assert read_warc(spark, write_warc(spark.createDataFrame([], PAGES))).count() == 0
    clashing = pages(spark).withColumns({c: F.lit("x") for c in ("sha1", "size", "payload", "refers_to", "of_page", "part", "data")})
    assert read_warc(spark, write_warc(clashing)).where("last").count() == 8


def test_equal_rows_and_null_identifiers(spark):
    frame = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, None, None)], PAGES)
    rows = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in read_warc(spark, write_warc(frame)).where("last").collect())
    assert rows == [(0, "response", None), (0, "revisit", 1), (1, "response", None), (1, "revisit", 1)]


def test_chunks_are_cut_row_by_row(spark):
    frame = spark.createDataFrame([(1, bytearray(range(256)) * 1000), (2, bytearray()), (3, bytearray(b"x" * 100))], "page_id long, payload binary")
    rows = chunk_rows(frame, 100)
    assert "transform" not in rows._jdf.queryExecution().optimizedPlan().toString()
    parts = {}
    for r in sorted(rows.collect(), key=lambda r: (r.page_id, r.chunk_no)):
        parts.setdefault(r.page_id, []).append(bytes(r.data))
    assert {k: b"".join(v) for k, v in parts.items()} == {r.page_id: bytes(r.payload) for r in frame.collect()}
    assert [len(parts[k]) for k in (1, 2, 3)] == [2560, 1, 1] and max(len(x) for v in parts.values() for x in v) == 100


def test_a_large_payload_round_trip(spark):
    html = "".join(chr(97 + k % 23) for k in range(1 << 16)) * 320  # 21 MB
    frame = spark.createDataFrame([(1, "u", html), (2, "u", html), (3, "u", "small")], PAGES)
    last = {r.page_id: r for r in read_warc(spark, write_warc(frame), with_data=False).where("last").collect()}
    assert (last[2].payload_digest, last[2].payload_bytes, last[2].chunk_no) == (digest(html.encode()), len(html), 319)
    assert (last[1].record_type, last[1].refers_to) == ("revisit", 2)


def test_a_shared_payload_is_settled_over_the_leaves(spark):
    frame = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, '', concat('p', id % 10)) AS html")
    got = {r.page_id: (r.record_type, r.refers_to) for r in read_warc(spark, write_warc(frame), with_data=False).where("last").collect()}
    rows = {r.page_id: r.html for r in frame.collect()}
    keeper = {html: max(i for i, h in rows.items() if h == html) for html in set(rows.values())}
    assert got == {i: ("response", None) if keeper[h] == i else ("revisit", keeper[h]) for i, h in rows.items()}


def test_damage_is_noticed():
    import pytest

    with pytest.raises(ValueError, match="not a WARC"):
        list(records_of(io.BytesIO(b"junk\r\n\r\n"), False))
