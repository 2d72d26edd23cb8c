"""Web archives: write pages as WARC records, read them back by segment reassembly.

Writing is DataFrame expressions.  A record's block is an HTTP response with
chunked transfer framing; a block over the segment size is split at character
boundaries into a first record and ``continuation`` records that name it
(WARC-Segment-Origin-ID, -Number, and -Total-Length on the last).  Of equal
payloads one record is the response and the others are revisits of it.  The
files are plain WARC, gzipped: Spark's text writer puts the record end, two
line ends, after each record.

Reading parses every file by its Content-Length fields in ``mapInArrow`` (a
file holds a bounded number of records of bounded size).  Continuations are
grouped by their origin id, ordered by segment number, checked against the
total length, and only then is the chunked framing decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codecorpus.llm.common import cut

#: Characters in a chunk of the transfer framing and in a segment of a block.
CHUNK_CHARS = 4096
SEGMENT_CHARS = 65536
#: Records in one archive file.
FILE_RECORDS = 2000
CRLF = "\r\n"
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base32: four base-32 digits from each 20 bits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def pieces(text: Column, chars: int) -> Column:
    """``text`` cut into pieces of at most ``chars`` characters."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % chars), F.lit(0))


def chunked(payload: Column, chars: int = CHUNK_CHARS) -> Column:
    """``payload`` in chunked transfer framing."""
    framed = F.transform(pieces(payload, chars), lambda c: F.concat(
        F.lower(F.hex(F.octet_length(c))), F.lit(CRLF), c, F.lit(CRLF)))
    return F.concat(F.array_join(framed, ""), F.lit("0" + CRLF + CRLF))


def record_id(*parts) -> Column:
    digest = F.md5(F.concat_ws("/", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _keys():
    return F.coalesce("page_id", F.lit(0)).alias("pid"), F.col("page_id").isNull().alias("pnull"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("payload_hash")


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row per page id and payload: ``pid, pnull, payload_hash, refers_to, refers_rest``.

    Of equal payloads of at least ``least_bytes`` bytes, the largest page id is
    the response; ``refers_to`` is what this page refers to (null: nothing),
    ``refers_rest`` the same for rows that repeat both id and payload.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = cut(pages.select("page_id", *_keys(), F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).alias("n")).distinct())
    first = rows.groupBy("sha256").agg(F.max("page_id").alias("keep_id"))
    target = page_key("keep_id", F.lit(1), "payload_hash")
    small = F.col("n") < least_bytes
    return rows.join(first, "sha256").select(
        "pid", "pnull", "payload_hash", F.when(~small & ~F.col("page_id").eqNullSafe(F.col("keep_id")), target).alias("refers_to"),
        F.when(~small, target).alias("refers_rest"))


def page_key(page_id, nth, payload_hash) -> Column:
    """Record id of a page: its id, which of its equal rows it is, and its payload."""
    return record_id(F.coalesce(F.col(page_id).cast("string"), F.lit("")), nth.cast("string"), F.col(payload_hash).cast("string"))


def line(name: str, value) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def records(pages: DataFrame, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
            segment_chars: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per record: ``value``, header and block without the record end.

    Null html is an empty payload.  Line ends in urls are percent-encoded;
    null urls and page ids leave their header line out.
    """
    payload = F.coalesce("html", F.lit(""))
    keys = ["pid", "pnull", "payload_hash"]
    rows = pages.select("page_id", "url", payload.alias("payload"), *_keys())
    # The window and the join deal rows out by the same keys: the payload moves once.
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("url")))
    full = rows.join(roles(pages, least_bytes), keys).withColumn(
        "refers_to", F.when(F.col("nth") == 1, F.col("refers_to")).otherwise(F.col("refers_rest")))
    block = F.when(F.col("refers_to").isNull(), F.concat(F.lit(HTTP_HEAD), chunked(F.col("payload"), chunk_chars))).otherwise(F.lit(HTTP_HEAD))
    parts = full.select(
        "page_id", "nth", "payload_hash", "refers_to", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        sha1_base32(F.col("payload")).alias("digest"), F.octet_length(block).alias("total"),
        F.posexplode(pieces(block, segment_chars)).alias("pos", "segment"),
        F.size(pieces(block, segment_chars)).alias("segments"))
    origin = page_key("page_id", F.col("nth"), "payload_hash")
    first, split = F.col("pos") == 0, F.col("segments") > 1
    kind = F.when(~first, "continuation").when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    own_id = F.when(first, origin).otherwise(record_id(origin, F.col("pos").cast("string")))
    head = F.concat(
        F.lit(VERSION + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", own_id), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")), line("X-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
        line("WARC-Profile", F.when(first & F.col("refers_to").isNotNull(), F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To", F.when(first, F.col("refers_to"))),
        line("WARC-Segment-Number", F.when(split, (F.col("pos") + 1).cast("string"))),
        line("WARC-Segment-Origin-ID", F.when(~first, origin)),
        line("WARC-Segment-Total-Length", F.when(split & (F.col("pos") + 1 == F.col("segments")), F.col("total").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        line("Content-Length", F.octet_length("segment").cast("string")), F.lit(CRLF))
    return parts.select(F.concat(head, F.col("segment")).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, **sizes) -> None:
    """Write the pages' archive files below ``path``."""
    (records(pages, least_bytes, **sizes).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


# -- reading ---------------------------------------------------------------

def parse(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """The records of one archive file: lower-cased header fields and the block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        at = start + int(head["content-length"])
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record of {head.get('warc-record-id')} does not end at its length")
        yield head, data[start:at]
        at += 4


def unchunk(framed: bytes) -> bytes:
    """Payload of a body in chunked transfer framing."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        n = int(framed[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(framed[end + 2:end + 2 + n])
        at = end + 2 + n
        if framed[at:at + 2] != b"\r\n":
            raise ValueError("chunk does not end at its length")
        at += 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body


PARSED = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                    ("refers_to", pa.string()), ("digest", pa.string()), ("origin", pa.string()), ("segment", pa.int32()),
                    ("total", pa.int64()), ("payload", pa.binary()), ("part", pa.binary())])
PARSED_DDL = ("record_id string, record_type string, page_id long, url string, refers_to string, digest string, "
              "origin string, segment int, total long, payload binary, part binary")
BATCH_BYTES = 16 << 20


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            for head, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                number, kind = head.get("warc-segment-number"), head["warc-type"]
                if kind not in ("response", "revisit", "continuation"):
                    continue
                page, total = head.get("x-page-id"), head.get("warc-segment-total-length")
                rows.append({
                    "record_id": head["warc-record-id"], "record_type": kind, "page_id": page and int(page),
                    "url": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"),
                    "digest": head.get("warc-payload-digest", "").removeprefix("sha1:"),
                    "origin": (head.get("warc-segment-origin-id") or head["warc-record-id"]) if number else None,
                    "segment": number and int(number), "total": total and int(total),
                    "payload": payload_of(block) if kind == "response" and not number else None,
                    "part": block if number else None})
                held += len(block) + 500
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, PARSED)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, PARSED)


def read_records(spark, path: str) -> DataFrame:
    """All records below ``path``; unsegmented responses with their payload,
    segmented ones (``segment`` not null) with their part of the block."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, PARSED_DDL)


WHOLE_DDL = "record_id string, record_type string, page_id long, url string, refers_to string, digest string, status string, payload binary"
WHOLE = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                   ("refers_to", pa.string()), ("digest", pa.string()), ("status", pa.string()), ("payload", pa.binary())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            parts = row.pop("parts")
            block, first = b"".join(p["part"] for p in parts), parts[0]
            whole = ([p["segment"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(block))
            yield pa.RecordBatch.from_pylist([{
                **{k: first[k] for k in ("record_id", "record_type", "page_id", "url", "refers_to", "digest")},
                "status": "ok" if whole else "incomplete", "payload": payload_of(block) if whole else None}], WHOLE)


def reassemble(parsed: DataFrame) -> DataFrame:
    """One row per archived page: ``record_id, record_type, page_id, url,
    refers_to, digest, status, payload``.

    Segments are grouped by origin id (a group is one page's block).  A block
    with a missing segment, or whose length is not the total that its last
    segment names, has status ``incomplete`` and no payload.  Revisits have no
    payload of their own.
    """
    single = parsed.where("segment IS NULL").select(
        "record_id", "record_type", "page_id", "url", "refers_to", "digest", F.lit("ok").alias("status"), "payload")
    part = F.struct("segment", "total", "part", "record_id", "record_type", "page_id", "url", "refers_to", "digest")
    grouped = (parsed.where("segment IS NOT NULL").groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"))
               .drop("origin"))
    return single.unionByName(grouped.mapInArrow(_joined, WHOLE_DDL))


DIGEST_DDL = ("record_id string, record_type string, page_id long, refers_to string, digest string, status string, "
              "payload_bytes long, payload_digest string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests = [], []
        for value in batch.column("payload"):
            data = value.as_py()
            sizes.append(None if data is None else len(data))
            digests.append(None if data is None else base64.b32encode(hashlib.sha1(data).digest()).decode())
        kept = ["record_id", "record_type", "page_id", "refers_to", "digest", "status"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in kept] + [pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
            kept + ["payload_bytes", "payload_digest"])


def page_index(pages: DataFrame) -> DataFrame:
    """One row per record of ``reassemble``: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, status``.

    The payload's size and digest are computed from the payload read back;
    those of a revisit from the response that it refers to (status
    ``no_response`` if there is none, ``wrong_digest`` if a record's own
    digest field differs).
    """
    found = cut(pages.mapInArrow(_digests, DIGEST_DDL))
    target = found.where("record_type = 'response'").select(
        F.col("record_id").alias("to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"),
        F.col("payload_digest").alias("to_digest"))
    both = found.join(target, F.col("refers_to") == F.col("to"), "left")
    revisit = F.col("record_type") == "revisit"
    digest = F.when(revisit, F.col("to_digest")).otherwise(F.col("payload_digest"))
    status = (F.when(F.col("status") != "ok", F.col("status")).when(revisit & F.col("to").isNull(), "no_response")
              .when(digest != F.col("digest"), "wrong_digest").otherwise("ok"))
    return both.select(
        "page_id", F.when(revisit, F.col("to_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        digest.alias("payload_digest"), "record_type", F.when(revisit, F.col("to_page")).alias("refers_to"), status.alias("status"))
