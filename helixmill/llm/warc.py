"""WARC archives: written with segments and chunked bodies, read back by segment reassembly.

A page becomes a response record whose HTTP body is framed in chunks, or a revisit of the record that holds the same
payload. A block longer than a segment goes on in continuation records. To read, archives are parsed file by file; the
pieces of each record are grouped by their origin, put in order of segment number, checked against the total length that
the last one states, and the chunk framing is taken off. A record's group is as large as that one record. The digest of
what was read is compared with the declared one, and a revisit takes its payload's length and digest from the record that
it refers to. Damaged records are reported, not raised.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.llm.common import reachable, stored

SEGMENT = 64 << 10
CHUNK = 16 << 10
LEAST = 1000
PER_FILE = 2000


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """Takes chunk framing off; raises ValueError where it is broken. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        n = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if framed[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        out.append(framed[at : at + n])
        at += n + 2


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to and nth: of pages of one id and digest, a number from 1 on.

    refers_to is the page whose record a page revisits, null for a response. Equal payloads of LEAST bytes or more go to
    the largest page_id; rows that have that id themselves are responses, and so are rows with a null id. Ids and digests
    are joined first; then pages meet their few revisits by id. Other columns of pages are not read.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest")
    d = pages.select("page_id", digest, F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    d = d.where((F.col("n") >= LEAST) & F.col("page_id").isNotNull())
    last = d.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_first")).where("_first < refers_to")
    again = d.join(last, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    rows = pages.select("page_id", "url", "html", digest)
    rows = rows.join(again.hint("shuffle_hash"), ["page_id", "digest"], "left")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")))


def _head(kind: str, fields: dict[str, object], size: int) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {size}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()


def record_id(page_id, digest: str, nth: int = 1) -> str:
    """The same in every archive of the same pages, so a revisit can name the first response of its page."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{nth}>"


def records(page_id, url, html, digest, refers_to, nth: int, date: str) -> Iterator[bytes]:
    """The records of a page, without the two line ends after each."""
    body, name = (html or "").encode("utf-8", "surrogatepass"), record_id(page_id, digest, nth)
    fields = {"WARC-Record-ID": name, "WARC-Date": date, "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"), "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response"}
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body)
        yield _head("revisit", fields | {"WARC-Refers-To": record_id(refers_to, digest), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, len(block)) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    if len(parts) == 1:
        yield _head("response", fields, len(block)) + block
        return
    yield _head("response", fields | {"WARC-Segment-Number": 1}, len(parts[0])) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        own = {"WARC-Record-ID": f"{name[:-1]}:{k}>", "WARC-Date": date, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": k}
        yield _head("continuation", own | ({"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}), len(part)) + part


def write(pages: DataFrame, path: str, date: str | None = None) -> None:
    """A gzipped WARC archive in files of PER_FILE records at most. pages: page_id, url, html; null html is an empty payload.

    date is that of all records; the present time if it is not given.
    """
    reachable(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in records(*row, date):
                    out.append(r)
                    size += len(r)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = plan(pages).select("page_id", "url", "html", "digest", "refers_to", "nth").mapInArrow(run, "value binary")
    # the text sink writes the bytes of a string as they are, and ends each record with its two line ends
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


_FIELD = re.compile(rb"([A-Za-z-]+): *([^\r\n]*)\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n")


def parsed(raw: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields, by lower-case name, and block of every record of an uncompressed archive.

    The block of a record is None if its header or its block ends early or its length is no number; the search then goes
    on behind its first line.
    """
    at = 0
    while m := _START.search(raw, at):
        end = raw.find(b"\r\n\r\n", m.end() - 2)
        stop = len(raw) if end < 0 else end + 2
        fields = {f[1].decode().lower(): f[2].decode("utf-8", "replace") for f in _FIELD.finditer(raw, m.end(), stop)}
        size = fields.get("content-length", "")
        if end < 0 or not (size.isascii() and size.isdigit()) or stop + 2 + int(size) > len(raw):
            yield fields, None
            at = m.end()
        else:
            at = stop + 2 + int(size)
            yield fields, raw[stop + 2 : at]


def _unzipped(raw: bytes) -> bytes:
    """What can be read of an archive, which may be one gzip member or one for each record."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            for a in range(0, len(raw), 1 << 16):  # in parts, so that those before an error are kept
                out.append(z.decompress(raw[a : a + (1 << 16)]))
                if z.eof:
                    break
        except zlib.error:
            break
        raw = z.unused_data + raw[a + (1 << 16) :] if z.eof else b""
    return b"".join(out) if out else raw


def opened(block: bytes) -> tuple[int, str, bytes] | None:
    """Length, digest and bytes of the payload of a response's whole block; None where its framing is broken."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = {m[1].decode().lower(): m[2] for m in _FIELD.finditer(head + b"\r\n")}
    if http.get("transfer-encoding", b"").lower() == b"chunked":
        try:
            body = dechunked(body)
        except ValueError:
            return None
    return len(body), hashlib.sha1(body).hexdigest(), body


def _number(x: str | None) -> int | None:
    return int(x) if x and x.isascii() and x.isdigit() else None


def _piece(fields: dict[str, str], block: bytes | None) -> dict:
    """A row of a record, or of one segment of it, whose block is kept until the others are there."""
    kind, name = fields.get("warc-type"), fields.get("warc-record-id")
    row = {
        "origin": fields.get("warc-segment-origin-id", name),
        "record_type": None if kind == "continuation" else kind,
        "refers": fields.get("warc-refers-to"),
        "declared": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "damaged": block is None,
    }
    if block is None:
        return row
    if "warc-segment-number" in fields:
        return row | {"number": _number(fields["warc-segment-number"]) or 0, "total": _number(fields.get("warc-segment-total-length")), "block": block}
    if kind == "response":
        got = opened(block)
        row |= {"damaged": got is None} if got is None else {"payload_bytes": got[0], "payload_digest": got[1]}
    return row


_PIECE = pa.schema([("origin", pa.string()), ("record_type", pa.string()), ("refers", pa.string()), ("declared", pa.string()), ("damaged", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
_WHOLE = pa.schema([_PIECE.field(c) for c in ("origin", "record_type", "refers", "declared", "damaged", "payload_bytes", "payload_digest")])


def _joined(row: dict) -> dict:
    """A record from its segments: each number from 1 on once, in order, and as long together as the last one states."""
    parts, total = row.pop("parts"), row.pop("total")
    if parts:
        block = b"".join(p["block"] for p in parts)
        whole = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and total == len(block)
        got = opened(block) if whole and row["record_type"] == "response" else None
        row["damaged"] = row["damaged"] or got is None
        row["payload_bytes"], row["payload_digest"] = got[:2] if got else (None, None)
    return row


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below path: page_id, record_type, refers_to, payload_bytes, payload_digest, complete.

    complete is false, and length and digest are null, for a record that is cut off, has a segment missing, repeated or of
    the wrong total length, has broken chunk framing or another digest than it declares, and for a revisit of a record
    that is not there, or not complete, or declares another digest. Parts of damaged headers have what could be read of
    them; records without any name are one row. An archive without records gives no rows.
    """
    reachable(spark)
    text = lambda t: t.replace("large_", "").replace("int64", "long").replace("int32", "int").replace("bool", "boolean")
    ddl = lambda schema: ", ".join(f"{f.name} {text(str(f.type))}" for f in schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_pylist([_piece(f, block) for f, block in parsed(_unzipped(content.as_py()))], _PIECE)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_joined(r) for r in batch.to_pylist()], _WHOLE)

    files = spark.read.format("binaryFile").load(path).select("content")
    pieces = files.mapInArrow(cut, ddl(_PIECE))
    part = F.when(F.col("number").isNotNull(), F.struct("number", "block"))
    once = ("record_type", "refers", "declared", "damaged", "payload_bytes", "payload_digest", "total")
    groups = pieces.groupBy("origin").agg(*(F.max(c).alias(c) for c in once), F.array_sort(F.collect_list(part)).alias("parts"))
    rows = stored(groups.select(*(f.name for f in _WHOLE), "total", "parts").mapInArrow(joined, ddl(_WHOLE)))
    rows = rows.withColumn("_good", ~F.col("damaged") & (F.col("payload_digest") == F.coalesce("declared", "payload_digest")))
    first = rows.where("record_type = 'response' AND _good").select(F.col("origin").alias("refers"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    rows = rows.join(first, "refers", "left")
    again = F.col("record_type") == "revisit"
    good = F.coalesce(F.when(again, ~F.col("damaged") & (F.col("_digest") == F.coalesce("declared", "_digest"))).otherwise(F.col("_good")), F.lit(False))
    page = lambda name: F.when(F.regexp_extract(name, r"^<urn:page:(-?\d+):", 1) != "", F.regexp_extract(name, r"^<urn:page:(-?\d+):", 1).cast("long"))
    return rows.select(
        page("origin").alias("page_id"),
        "record_type",
        F.when(again, page("refers")).alias("refers_to"),
        F.when(good, F.when(again, F.col("_bytes")).otherwise(F.col("payload_bytes"))).alias("payload_bytes"),
        F.when(good, F.when(again, F.col("_digest")).otherwise(F.col("payload_digest"))).alias("payload_digest"),
        good.alias("complete"),
    )
