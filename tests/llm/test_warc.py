import base64
import hashlib

import pytest

from storelens.llm.warc import PIECE, chunked, http_payload, page_records, parsed, read_warc, reassembled, write_warc

BIG = "é" * 60_001 + "\r\n\r\nWARC/1.1\r\n"
PAGES = [(5, "http://a/", "same"), (3, None, "same"), (9, "http://b/ \r\nx", "same"), (1, "u", None), (2, "u", ""), (4, "u", BIG), (7, "u", BIG),
         (6, "u", "0\r\n\r\n"), (None, "u", "same"), (None, "u", "nameless"), (8, "u", "one"), (8, "u", "one"), (10, "u", "zwölf" * 3000)]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("compression, smallest", [("gzip", 0), ("none", 10)])
def test_round_trip(spark, tmp_path, compression, smallest):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as refers", "2 as _rank").repartition(3)
    write_warc(df, f"{tmp_path}/w", smallest_revisit=smallest, segment_bytes=1 << 14, compression=compression)
    got = [(str(r.page_id), r.kind, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload))
           for r in read_warc(spark, f"{tmp_path}/w").collect()]
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        again = len(raw) >= smallest and first is not None and i != first
        want.append((str(i), "revisit" if again else "response", len(raw), digest(html), f"<urn:page:{first}>" if again else None, None if again else raw))
    assert sorted(got, key=str) == sorted(want, key=str)


def pieces(spark, records):
    rows = []
    for r in records:
        (h, block), = parsed(r + b"\r\n\r\n")
        rows.append((h["warc-type"], h["warc-record-id"], 4, None, h.get("warc-payload-digest", "")[5:] or None,
                     h.get("warc-segment-origin-id", h["warc-record-id"]), int(h["warc-segment-number"]),
                     int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block))
    return spark.createDataFrame(rows, PIECE)


def test_reassembly_checks(spark):
    records = list(page_records("k", 4, None, BIG.encode(), None, 10_000, 1000))
    assert len(records) > 5
    whole, = reassembled(pieces(spark, records[::-1] + records[2:4])).collect()  # any order, some twice
    assert bytes(whole.payload) == BIG.encode() and whole.page_id == 4 and whole.payload_digest == digest(BIG)
    for broken in (records[:-1], records[:2] + records[3:], records[:1] + records[1:-1] + [records[-1].replace(b"Total-Length: ", b"Total-Length: 1")]):
        bad, = reassembled(pieces(spark, broken)).collect()
        assert bad.payload is None and bad.payload_bytes is None
    assert reassembled(pieces(spark, records).limit(0)).count() == 0


def test_chunks():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    for body in (b"", b"x", b"abc" * 1000, b"\r\n0\r\n\r\n"):
        assert http_payload(head + chunked(body, 7))[1] == body
    assert http_payload(head + b"5;ext=1\r\nhello\r\n0\r\n\r\n")[1] == b"hello"
    assert http_payload(head + b"5\r\nhel")[1] is None and http_payload(head + b"zz\r\n")[1] is None


def test_empty_table(spark, tmp_path):
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert read_warc(spark, f"{tmp_path}/w").count() == 0
