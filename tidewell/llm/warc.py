"""WARC archives: written from pages, read back, assembled into transactions.

Writing makes three records a page: a response (or a revisit, where a page with
a larger id has the same payload), the request, and a metadata record; the two
last name the first in ``WARC-Concurrent-To``.  It is all column expressions
and Spark's text sink, whose line separator ends a WARC record, so archives are
plain gzip files in any store that Spark can write to.

Reading parses whole archives by ``Content-Length`` and assembles transactions:
request and metadata records join their response or revisit through the
concurrent-to identifier, one nested row a capture.

Nulls: a null payload is an empty one, a null URL an empty one, a null id has
an empty ``page-id`` field and comes back null.  Pages that tie for the largest
id of a payload are all responses.  Repeated rows are repeated captures.  Empty
tables give empty archives and no rows.  Other columns are not read.

Scale: one SHA-1 a payload, staged with the ids; only these rows are shuffled to
find revisits, those of one payload in as many tasks as there are partitions.
Payloads are shuffled once by their unique ids.  Archives are bounded by records
and by bytes and read as a stream, batch by batch; a capture has three records,
and only revisits are joined to what they refer to, salted like their payloads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import common

RECORDS_PER_FILE = 9000
#: payloads of an archive, at most, if it has several; those above ``SMALL_BYTES``
#: have archives of their own, so that a few of them don't make all archives short
ARCHIVE_BYTES, SMALL_BYTES = 256 << 20, 1 << 18
#: what a reader gives out at once
BATCH_RECORDS, BATCH_BYTES = 2048, 8 << 20
CRLF = "\r\n"
#: fixed value: the profile of a revisit by digest
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: digits of the base that Spark spells 32 in
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32(digest: Column) -> Column:
    """Upper-case base32 of the 20 bytes of a SHA-1: each 10 of its 40 hex digits are 8 letters."""
    spelt = F.hex(digest)
    parts = [F.lpad(F.conv(F.substring(spelt, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, ALPHABET)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str | Column, rid: Column, uri: Column, date: str, mime: str, block: Column, more: list[Column]) -> Column:
    head = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), rid)]
    head += [F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri), *more, F.lit(f"Content-Type: {mime}")]
    head += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), block)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the archives of ``pages`` to the folder ``path``."""
    spark = pages.sparkSession
    uri = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A")
    base = pages.select(F.col(key).alias("id"), uri.alias("uri"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    base = base.withColumn("print", F.xxhash64("body")).withColumn("size", F.octet_length("body"))
    # the only SHA-1 of a payload; rows meet it again by id, URL, size and a quick hash
    hashed = F.unhex(F.sha1(F.col("body").cast("binary")))
    small = common.staged(base.select("id", "uri", "print", "size", hashed.alias("hash")).distinct(), "payloads")
    shared = small.where(F.col("size") >= min_revisit_bytes).groupBy("hash").agg(F.count("*").alias("n"), F.max(F.struct("id", "uri")).alias("first")).where("n > 1").select("hash", "first")
    plan = common.join_salted(small, shared, ["hash"], ["id", "uri"], "left")
    plan = plan.withColumn("first", F.when((F.col("size") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("first.id")), F.col("first")))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("id", "uri", "print", "size")]
    joined = base.alias("a").join(plan.hint("shuffle_hash").alias("b"), keys).select("a.id", "a.uri", "body", "a.size", "hash", "first").withColumn("digest", base32(F.col("hash")))
    text_id, uri_, digest, size = F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("uri"), F.col("digest"), F.col("size")
    joined = joined.withColumn("own", _uuid(F.lit("capture"), text_id, uri_, digest))
    own = F.col("own")
    origin = _uuid(F.lit("capture"), F.coalesce(F.col("first.id").cast("string"), F.lit("")), F.col("first.uri"), digest)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))
    hashed = F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest)
    response = _record("response", own, uri_, date, "application/http;msgtype=response", F.concat(http, F.col("body")), [hashed])
    revisit = _record(
        "revisit", own, uri_, date, "application/http;msgtype=response", http,
        [hashed, F.lit(f"WARC-Profile: {REVISIT}"), F.concat(F.lit("WARC-Refers-To: "), origin), F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.col("first.uri"))],
    )
    with_it = [F.concat(F.lit("WARC-Concurrent-To: "), own)]
    site = F.regexp_extract(uri_, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path_ = F.regexp_extract(uri_, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(path_ == "", "/").otherwise(path_), F.lit(f" HTTP/1.1{CRLF}Host: "), site, F.lit(CRLF * 2))
    about = F.concat(F.lit("page-id: "), text_id, F.lit(f"{CRLF}payload-length: "), size.cast("string"), F.lit(CRLF))
    request = _record("request", _uuid(F.lit("request"), text_id, uri_, digest), uri_, date, "application/http;msgtype=request", ask, with_it)
    metadata = _record("metadata", _uuid(F.lit("metadata"), text_id, uri_, digest), uri_, date, "application/warc-fields", about, with_it)
    largest = small.agg(F.max("size")).first()[0] or 0
    classes = [(size <= SMALL_BYTES, min(largest, SMALL_BYTES))] + ([(size > SMALL_BYTES, largest)] if largest > SMALL_BYTES else [])
    for part, most in classes:
        records = joined.where(part).select(F.explode(F.array(F.when(F.col("first").isNull(), response).otherwise(revisit), request, metadata)).alias("value"))
        per_file = min(RECORDS_PER_FILE, 3 * max(1, ARCHIVE_BYTES // max(most, 1)))
        records.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, plain or
    of gzip members; never more than a record is unpacked at once."""
    raw = io.BytesIO(archive)
    f = gzip.GzipFile(fileobj=raw) if archive[:2] == b"\x1f\x8b" else raw
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        if not line:
            raise ValueError("archive ends in the headers of a record")
        n = int(head["content-length"])
        block = f.read(n)
        if len(block) < n:
            raise ValueError("archive ends in the block of a record")
        yield head, block


_SCHEMA = "kind string, record_id string, concurrent_to string, uri string, refers_to string, digest string, computed string, fields string, size long, payload binary"


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in a folder; ``computed`` and ``size`` are of the
    payload as it stands there."""

    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    types = [pa.string()] * 8 + [pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows, held = [], 0
                for head, block in records_of(b.column("content")[i].as_py()):
                    kind = head.get("warc-type", "")
                    is_http = head.get("content-type", "").startswith("application/http")
                    body = block.partition(b"\r\n\r\n")[2] if is_http else block
                    mark = base64.b32encode(hashlib.sha1(body).digest()).decode() if kind == "response" else None
                    rows.append((kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-refers-to"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None, mark, block.decode() if kind == "metadata" else None, len(body), body if with_payload and kind == "response" else None))
                    held += len(body) if with_payload else 0
                    if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _SCHEMA)


def captures(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One nested row a capture: record, request, metadata, and what a revisit refers to."""
    all_ = common.staged(read_records(spark, path, with_payload), "warc-records")
    main = all_.where(F.col("kind").isin("response", "revisit"))

    def beside(kind: str) -> DataFrame:
        cols = F.struct("record_id", "uri", "fields", "size").alias(kind)
        return all_.where(F.col("kind") == kind).dropDuplicates(["concurrent_to", "record_id"]).select(F.col("concurrent_to").alias("record_id"), cols)

    field = lambda name: F.regexp_extract(F.col("metadata.fields"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    whole = main.join(beside("request"), "record_id", "left").join(beside("metadata"), "record_id", "left")
    whole = whole.withColumn("page_id", F.when(field("page-id") != "", field("page-id")))
    # only revisits refer to something; thousands of them may refer to one response
    page = whole.where(F.col("kind") == "response").groupBy(F.col("record_id").alias("refers_to")).agg(F.min("page_id").alias("refers_to_page"))
    revisits = common.join_salted(whole.where(F.col("kind") == "revisit"), page, ["refers_to"], ["record_id"], "left")
    every = whole.where(F.col("kind") == "response").withColumn("refers_to_page", F.lit(None).cast("string")).unionByName(revisits)
    return every.select(
        "page_id",
        "uri",
        F.struct("record_id", "kind", "digest", "computed", "size", "refers_to", "payload").alias("record"),
        "request",
        "metadata",
        "refers_to_page",
        F.when(F.col("kind") == "response", F.col("size")).otherwise(field("payload-length").cast("long")).alias("payload_bytes"),
        F.coalesce("computed", "digest").alias("payload_digest"),
        ((F.col("kind") == "revisit") | (F.col("computed") == F.col("digest"))).alias("intact"),
    )
