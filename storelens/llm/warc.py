"""WARC archives: records written through Spark's text writer, and read back with
segment reassembly.

A response larger than ``segment_bytes`` is written as a first record and
continuation records, its HTTP body in chunked transfer framing.  The reader takes
any archives whose files fit in a task: records that stand alone are decoded where
they are parsed, continuation records are grouped by origin identifier, ordered by
segment number, checked against the total length and then decoded the same way.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import free_name, require

END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_YIELD_BYTES = 8 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing

def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0" + END


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record without its closing blank lines (the writer's line separator adds those)."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def page_records(key: str, page: int | None, url: str | None, payload: bytes, refers: int | None,
                 segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    url = url and _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    head = [("WARC-Record-ID", f"<urn:page:{page}:{key}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url or None),
            ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("X-Page-ID", page if page is None else str(page)),
            ("Content-Type", "application/http;msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        yield record("revisit", head, http + b"Content-Length: %d" % len(payload) + END)
        return
    block = http + b"Transfer-Encoding: chunked" + END + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record("response", head, block)
        return
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield record("response", [*head, ("WARC-Segment-Number", "1")], parts[0])
    for n, part in enumerate(parts[1:], 2):
        last = ("WARC-Segment-Total-Length", str(len(block)) if n == len(parts) else None)
        yield record("continuation", [("WARC-Record-ID", f"<urn:page:{page}:{key}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", head[0][1]),
                                      ("WARC-Segment-Number", str(n)), last], part)


def with_revisits(pages: DataFrame, page_id: str, payload: str, smallest: int, out: str) -> DataFrame:
    """``pages`` with ``out``: the smallest page id of an equal payload, for rows that are not it.

    Only (id, digest) pairs are grouped; payloads then move once, by id and digest,
    so a payload that a third of all pages share does not meet in one task."""
    rank, digest, first = (free_name(pages, n) for n in ("_rank", "_digest", "_first"))
    order = F.coalesce(F.col(f"`{page_id}`").cast("long"), F.lit((1 << 63) - 1))
    pages = pages.withColumns({rank: order, digest: F.sha2(F.col(f"`{payload}`").cast("binary"), 256)})
    narrow = pages.filter(F.octet_length(f"`{payload}`") >= smallest).select(rank, digest)
    firsts = narrow.groupBy(digest).agg(F.min(rank).alias(first), F.max(rank).alias("_last")).filter(f"`{first}` < _last").drop("_last")
    repeats = narrow.join(firsts, digest).filter(F.col(rank) > F.col(first)).groupBy(rank, digest).agg(F.min(first).alias(out))
    return pages.join(repeats, [rank, digest], "left").drop(rank, digest)


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
               smallest_revisit: int = 0, segment_bytes: int = 1 << 15, chunk_bytes: int = 1 << 13,
               file_records: int = 20_000, compression: str = "gzip") -> None:
    """Write one response or revisit record per page (more for segmented ones) below ``path``.

    Of pages with equal payloads of at least ``smallest_revisit`` bytes the one with
    the smallest id is a response, the others revisit it.  A null html is an empty
    payload; a null id ranks last and its record has no X-Page-ID; pages repeated
    with the same id and payload are each what the first of them is; a null url
    leaves the target out.  An empty table writes no records.
    """
    require(pages, page_id, url, html)
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page"), F.col(f"`{url}`").cast("string").alias("url"),
                        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("html"))
    rows = with_revisits(rows, "page", "html", smallest_revisit, "refers").select("page", "url", "html", "refers")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                n += 1
                for r in page_records(f"{part}-{n}", page, url, html.encode(), refers, segment_bytes, chunk_bytes):
                    out.append(r)
                    size += len(r)
                if size > _YIELD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", END.decode()).option("compression", compression)
     .option("maxRecordsPerFile", file_records).text(path))


# ---------------------------------------------------------------- reading

def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of one archive file."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.find(END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, length = end + 4, int(headers["content-length"])
        if start + length > len(data):
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, data[start:start + length]
        at = start + length + 4


def http_payload(block: bytes) -> tuple[dict[str, str], bytes | None]:
    """HTTP headers of a block and its body, chunked transfer framing decoded; the
    body is None if the framing is broken."""
    head, _, body = block.partition(END)
    lines = head.decode("latin-1").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if headers.get("transfer-encoding", "").lower() != "chunked":
        return headers, body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return headers, None
        if not size:
            return headers, b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


ALONE = "kind string, record_id string, page_id long, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
PIECE = "kind string, record_id string, page_id long, target_uri string, payload_digest string, origin string, segment int, total long, block binary"


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[-1] or b"") + 200
        if size > _YIELD_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _alone(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in files:
            for content in batch.column(0):
                for h, block in parsed(content.as_py()):
                    if "warc-segment-number" in h or h["warc-type"] not in ("response", "revisit"):
                        continue
                    http, payload = http_payload(block)
                    revisit = h["warc-type"] == "revisit"
                    size = _number(http.get("content-length")) if revisit else None if payload is None else len(payload)
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    if not revisit and payload is not None:
                        found = base32_sha1(payload)
                        payload, digest = (payload, found) if digest in ("", found) else (None, digest)
                    yield (h["warc-type"], h["warc-record-id"], _number(h.get("x-page-id")), h.get("warc-target-uri"),
                           h.get("warc-refers-to"), digest, size, None if revisit else payload)

    return _batches(rows(), _schema(ALONE))


def _pieces(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in files:
            for content in batch.column(0):
                for h, block in parsed(content.as_py()):
                    if "warc-segment-number" in h:
                        yield (h["warc-type"], h["warc-record-id"], _number(h.get("x-page-id")), h.get("warc-target-uri"),
                               h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                               h.get("warc-segment-origin-id", h["warc-record-id"]), int(h["warc-segment-number"]),
                               _number(h.get("warc-segment-total-length")), block)

    return _batches(rows(), _schema(PIECE))


def reassembled(pieces: DataFrame) -> DataFrame:
    """One row per origin identifier from its segments, with the decoded payload.

    Segments are ordered by number; of a segment that occurs twice one is used.  The
    payload is null when a number is missing, the total length is missing or wrong,
    the framing is broken or the digest differs.
    """
    one = pieces.groupBy("origin", "segment").agg(*[F.any_value(c).alias(c) for c in pieces.columns if c not in ("origin", "segment")])
    whole = one.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
                                      *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("kind", "page_id", "target_uri", "payload_digest")])

    @F.arrow_udf("struct<payload:binary,digest:string>")
    def decode(parts: pa.Array, total: pa.Array, digest: pa.Array) -> pa.Array:
        out = []
        for p, t, d in zip(parts.to_pylist(), total.to_pylist(), digest.to_pylist()):
            block, payload = b"".join(x["block"] for x in p), None
            if [x["segment"] for x in p] == list(range(1, len(p) + 1)) and t == len(block):
                payload = http_payload(block)[1]
            found = None if payload is None else base32_sha1(payload)
            payload = payload if d in (None, found) else None
            out.append((payload, found if d is None else d))
        return pa.StructArray.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.string())], names=["payload", "digest"])

    whole = whole.withColumn("decoded", decode("parts", "total", "payload_digest"))
    return whole.select("kind", F.col("origin").alias("record_id"), "page_id", "target_uri", F.lit(None).cast("string").alias("refers_to"),
                        F.col("decoded.digest").alias("payload_digest"), F.octet_length("decoded.payload").cast("long").alias("payload_bytes"),
                        F.col("decoded.payload").alias("payload"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of all archives below ``path`` (columns of ``ALONE``).

    ``payload`` is null for revisits and for records whose framing, length or digest
    is wrong; ``payload_bytes`` of a revisit is the Content-Length it states."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_alone, ALONE).unionByName(reassembled(files.mapInArrow(_pieces, PIECE)))
