"""WARC archives of pages, written and read back with segments reassembled.

Records are built and written by Spark's text writer (record terminator as the line separator; one gzip stream per
file, which readers of whole files take, but not those that seek to single records). A record's block is an HTTP response in chunked transfer framing; blocks beyond SEGMENT bytes are split into a
first segment and continuation records, so records, and with a bound on the records of a file the archive files too, have
a bounded size. Reading takes archive files as binary rows; continuation records are grouped by their origin's id,
ordered by segment number, checked against the total length that the last one states, and the framing is undone. A payload
whose digest is not the one that its record states is an error.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

SEGMENT = 32_768
CHUNK = 8_192
RECORDS_A_FILE = 1_024
LEAST_SHARED = 100
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}"
_PARSED = "record_id string, type string, page_id string, refers_to string, digest string, number long, total long, block binary, payload_bytes long, found_digest string"
_NAMES = [c.split()[0] for c in _PARSED.split(", ")]


def _bytes(c):
    return c.cast("binary")


def decide(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest, record id, and page and record id that a repeated payload refers to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    serial = F.monotonically_increasing_id().cast("string")  # tells rows that repeat a page_id apart
    rid = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), serial, F.lit(">"))
    rows = rows.withColumn("rid", rid).withColumn("digest", F.sha2(_bytes(F.col("payload")), 256))
    shared = F.octet_length("payload") >= LEAST_SHARED
    first = rows.where(shared & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "rid")).alias("first"), F.count("*").alias("n")).where("n > 1")
    key = F.when(shared, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))  # small payloads meet nothing
    rows = rows.withColumn("key", key).join(first.select(F.col("digest").alias("key"), "first"), "key", "left").drop("key")
    again = F.col("first")["page_id"] < F.col("page_id")
    return rows.select("*", F.when(again, F.col("first")["page_id"]).alias("refers_to"), F.when(again, F.col("first")["rid"]).alias("refers_rid")).drop("first")


def records(decided: DataFrame) -> DataFrame:
    """One row per WARC record (without its terminator), as a string of raw bytes."""
    body = _bytes(F.col("payload"))
    n_chunks = F.ceil(F.octet_length("payload") / F.lit(CHUNK)).cast("int")
    chunk = lambda i: F.substring(body, i * CHUNK + 1, F.lit(CHUNK))
    framed = F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda i: F.concat(F.lower(F.hex(F.octet_length(chunk(i)).cast("long"))), F.lit(CRLF), chunk(i).cast("string"), F.lit(CRLF)))
    framed = F.when(n_chunks > 0, F.array_join(framed, "")).otherwise(F.lit(""))
    block = F.when(F.col("refers_to").isNull(), F.concat(F.lit(HTTP_HEAD), framed, F.lit("0" + CRLF + CRLF))).otherwise(F.lit(f"HTTP/1.1 200 OK{CRLF}{CRLF}"))
    rows = decided.select("page_id", "url", "digest", "refers_to", "refers_rid", "rid", _bytes(block).alias("block"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("block") / F.lit(SEGMENT)).cast("int"))
    rows = rows.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    part = F.substring(F.col("block"), (F.col("i") - 1) * SEGMENT + 1, F.lit(SEGMENT))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    one = F.col("i") == 1
    many = F.col("n") > 1
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.when(~one, "continuation").when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
        field("WARC-Record-ID", F.when(one, F.col("rid")).otherwise(F.concat(F.rtrim(F.lit(">"), F.col("rid")), F.lit("#"), F.col("i").cast("string"), F.lit(">")))),
        field("WARC-Date", F.lit(datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))),
        field("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("refers_to").isNotNull(), F.concat(field("WARC-Refers-To", F.col("refers_rid")), F.when(one, field("WARC-Profile", F.lit(PROFILE))).otherwise(""))).otherwise(""),
        F.when(many, field("WARC-Segment-Number", F.col("i").cast("string"))).otherwise(""),
        F.when(~one, field("WARC-Segment-Origin-ID", F.col("rid"))).otherwise(""),
        F.when(many & (F.col("i") == F.col("n")), field("WARC-Segment-Total-Length", F.octet_length("block").cast("string"))).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        field("Content-Length", F.octet_length(part).cast("string")),
        F.lit(CRLF),
    )
    return rows.select(F.concat(head, part.cast("string")).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` as gzip-compressed WARC files of a bounded number of bounded records under ``path``."""
    records(decide(pages)).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def undo_chunks(block: bytes) -> bytes:
    """Payload of an HTTP response; chunked framing is undone if the head names it."""
    at = block.index(b"\r\n\r\n") + 4
    if b"transfer-encoding: chunked" not in block[:at].lower():
        return block[at:]
    out = []
    while True:
        end = block.index(b"\r\n", at)
        n = int(block[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if block[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk does not end where its length says")
        out.append(block[end + 2 : end + 2 + n])
        at = end + 4 + n


def inflate(content: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while content:
        d = zlib.decompressobj(31)
        out += [d.decompress(content), d.flush()]
        content = d.unused_data
    return b"".join(out)


def parse(data: bytes):
    """(headers, block) of every record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = {}
        for line in data[at:end].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        n = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _read(batches):
    for batch in batches:
        for content in batch.column("content").to_pylist():
            cols: list[list] = [[] for _ in _NAMES]
            for head, block in parse(inflate(content)):
                number = head.get("warc-segment-number")
                rid = head["warc-record-id"] if head["warc-type"] != "continuation" else head["warc-segment-origin-id"]
                payload = undo_chunks(block) if number is None and head["warc-type"] == "response" else None
                refers = head["warc-refers-to"].split(":")[2] if "warc-refers-to" in head else None
                if payload is not None and head.get("warc-payload-digest") != f"sha256:{hashlib.sha256(payload).hexdigest()}":
                    raise ValueError(f"record {rid}: the payload is not that of its digest")
                row = (rid, head["warc-type"], rid.split(":")[2], refers, head.get("warc-payload-digest", "").removeprefix("sha256:"), int(number or 1), int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None, block if number else None, None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest())
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_NAMES)


def _assemble(batches):
    names = ["page_id", "type", "refers_to", "digest", "payload_bytes", "found_digest"]
    for batch in batches:
        b = batch.to_pydict()
        size, found = [], []
        for rid, segments, n, digest, declared in zip(b["record_id"], b["segments"], b["payload_bytes"], b["found_digest"], b["digest"]):
            if segments:
                block = b"".join(s["block"] for s in segments)
                numbers = [s["number"] for s in segments]
                if numbers != list(range(1, len(segments) + 1)) or segments[-1]["total"] != len(block):
                    raise ValueError(f"record {rid} is not whole: segments {numbers}, {len(block)} bytes")
                payload = undo_chunks(block)
                stated, (n, digest) = declared, (len(payload), hashlib.sha256(payload).hexdigest())
                if digest != stated:
                    raise ValueError(f"record {rid}: the payload is not that of its digest")
            size.append(n)
            found.append(digest)
        yield pa.RecordBatch.from_arrays([pa.array(b[c], pa.string()) for c in names[:4]] + [pa.array(size, pa.int64()), pa.array(found, pa.string())], names=names)


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every whole record under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parts = files.mapInArrow(_read, _PARSED)
    segment = F.when(F.col("block").isNotNull(), F.struct("number", "total", "block"))
    whole = parts.groupBy("record_id").agg(
        F.sort_array(F.collect_list(segment)).alias("segments"),
        *[F.first(F.when(F.col("type") != "continuation", F.col(c)), ignorenulls=True).alias(c) for c in ("type", "page_id", "refers_to", "digest", "payload_bytes", "found_digest")],
    )
    got = whole.mapInArrow(_assemble, "page_id string, type string, refers_to string, digest string, payload_bytes long, found_digest string")
    got = got.select(F.expr("try_cast(page_id as bigint)").alias("page_id"), "payload_bytes", "digest", "found_digest", F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))
    response = got.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("found_digest").alias("digest"), F.col("payload_bytes").alias("n")).where("refers_to is not null").dropDuplicates(["refers_to", "digest"])
    out = got.join(response, ["refers_to", "digest"], "left")
    return out.select("page_id", F.coalesce("payload_bytes", "n").alias("payload_bytes"), F.coalesce("found_digest", "digest").alias("payload_digest"), "record_type", "refers_to")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back.

    Of records with equal payloads of at least 100 bytes the one with the smallest page_id is the response, the others
    revisit it. A null html is an empty payload; a null page_id is kept, never refers and is never referred to. Rows that
    repeat a page_id are records of their own (with one payload, all of the smallest page_id are responses). Other columns are not looked
    at. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
