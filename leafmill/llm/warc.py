"""WARC archives: writing pages, reading records, assembling transactions.

``write`` makes a request, a response (or revisit) and a metadata record for each page, each its
own gzip member, as the format asks for. Spark's text sink writes them to any file system: a gzip
member ends with the high byte of its length, 0 for members below 16 MB, so that byte serves as
the sink's line separator (a larger member is followed by an empty one). ``records`` parses by
Content-Length, never by searching for a separator. ``captures`` joins the records that name the
same response as concurrent and gives one nested row for each.

Defined cases: null html is an empty payload; a null url gives records without a target and reads
back as null; control characters in a url are percent-encoded; a null page_id has no metadata
field and reads back as null; of records with equal payloads that share the largest page_id
(repeated rows) all are responses; an empty table gives archives without records; extra columns
are not read; a request or metadata record whose response is missing is a capture without one.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_side

#: Smaller payloads are always written in full.
MIN_REVISIT_BYTES = 1000
#: Bytes of payload in one archive file, by the mean page; a file is read back as a whole. No file has
#: more than a task writes, which reads FILE_BYTES or so itself.
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = b"\r\n"
_EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
_RECORD = (
    "record_id string, warc_type string, concurrent_to string, target_uri string, date string, payload_digest string, "
    "status int, http_headers map<string,string>, payload binary, fields map<string,string>, request_line string"
)

_ARROW = pa.schema([(x.split(" ")[0], {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}[x.split(" ")[1]]) for x in _RECORD.split(", ")])


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in head], f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packer.compress("\r\n".join(lines).encode() + block + _CRLF * 2) + packer.flush()
    if data[-1]:
        data += _EMPTY_MEMBER
    return data[:-1]  # the sink adds the last byte, which is 0


def _build(run: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page, url, html, digest, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "revisit"))):
                ids = [f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{run}/{part}/{n}/{kind}')}>" for kind in ("response", "request", "metadata")]
                n += 1
                target = [] if url is None else [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))]
                common = [("WARC-Date", DATE), *target]
                split = _split(target[0][1] if target else "")
                out.append(_member(
                    [("WARC-Type", "request"), ("WARC-Record-ID", ids[1]), ("WARC-Concurrent-To", ids[0]), *common, ("Content-Type", "application/http;msgtype=request")],
                    f"GET {split[1]} HTTP/1.1\r\nHost: {split[0]}\r\n\r\n".encode(),
                ))
                payload = html.encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                kind = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE)] if revisit else [("WARC-Type", "response")]
                out.append(_member(
                    [*kind, ("WARC-Record-ID", ids[0]), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")],
                    http if revisit else http + payload,
                ))
                out.append(_member(
                    [("WARC-Type", "metadata"), ("WARC-Record-ID", ids[2]), ("WARC-Concurrent-To", ids[0]), *common, ("Content-Type", "application/warc-fields")],
                    b"" if page is None else f"page-id: {page}\r\n".encode(),
                ))
            yield from pa.Table.from_arrays([pa.array(out, pa.binary())], names=["value"]).to_batches(max_chunksize=3000)

    return rows


def _split(url: str) -> tuple[str, str]:
    try:
        u = urlsplit(url)
        return u.netloc, (u.path or "/") + (f"?{u.query}" if u.query else "")
    except ValueError:
        return "", "/"


def write(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Archive (page_id, url, html). Of equal payloads the one with the largest page_id is stored."""
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0.0
    per_file = 3 * max(1, int(file_bytes / (mean + 1000)))  # three records a page, with 1000 bytes of heads
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    large = own.where(F.octet_length("html") >= min_revisit_bytes)
    stored = large.groupBy("digest").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n"))
    stored = cut(stored.where("n > 1 AND stored IS NOT NULL").select("digest", "stored"), "stored-payloads")
    marked = own.join(small_side(stored, 100), "digest", "left")
    revisit = F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    rows = marked.select("page_id", "url", "html", "digest", revisit.alias("revisit"))
    members = rows.mapInArrow(_build(uuid.uuid4().hex), "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


def _members(data: bytes) -> Iterator[bytes]:
    view, at, step = memoryview(data), 0, 1 << 14
    while at < len(view):
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a gzip member")
            out.append(unpack.decompress(view[at : at + step]))
            at += min(step, len(view) - at)
        at -= len(unpack.unused_data)
        if any(out):
            yield b"".join(out)


def _headers(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive, gzipped by record or not at all."""
    for part in _members(data) if data[:2] == b"\x1f\x8b" else [data]:
        at = 0
        while at < len(part):
            end = part.index(_CRLF * 2, at)
            lines = part[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            head = _headers(lines[1:])
            start, n = end + 4, int(head["content-length"])
            yield head, part[start : start + n]
            at = start + n + 4


def _read(types: frozenset[str] | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=_ARROW)

        for batch in batches:
            for data in batch.column("content"):
                out, held = [], 0
                for head, block in parse(data.as_py()):
                    kind = head.get("warc-type")
                    if types and kind not in types:
                        continue
                    row = {"record_id": head.get("warc-record-id"), "warc_type": kind, "concurrent_to": head.get("warc-concurrent-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "payload_digest": head.get("warc-payload-digest")}
                    if kind in ("response", "revisit", "request"):
                        http, _, payload = block.partition(_CRLF * 2)
                        lines = http.decode("utf-8", "replace").split("\r\n")
                        row["http_headers"] = list(_headers(lines[1:]).items())
                        if kind == "request":
                            row["request_line"] = lines[0]
                        else:
                            row["status"] = int(lines[0].split(" ")[1])
                            row["payload"] = payload if kind == "response" else None
                            held += len(payload)
                    else:
                        row["fields"] = list(_headers(block.decode("utf-8", "replace").split("\r\n")).items())
                    out.append(row)
                    if len(out) >= 2000 or held >= 8 << 20:
                        yield flush(out)
                        out, held = [], 0
                if out:
                    yield flush(out)

    return rows


def records(spark: SparkSession, path: str, types: tuple[str, ...] = ()) -> DataFrame:
    """One row per record of the archives under path, of the given types only."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(frozenset(types) or None), _RECORD)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per capture: its id, target and date, the request, the response (with the
    payload; null in a revisit) and the metadata fields."""
    answers = records(spark, path, ("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "target_uri", "date",
        F.struct("warc_type", "status", F.col("http_headers").alias("headers"), "payload_digest", "payload").alias("response"),
    )
    is_request = F.col("warc_type") == "request"
    beside = records(spark, path, ("request", "metadata")).groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.first(F.when(is_request, F.struct("record_id", "request_line", F.col("http_headers").alias("headers"))), ignorenulls=True).alias("request"),
        F.first(F.when(~is_request, F.col("fields")), ignorenulls=True).alias("metadata"),
        F.first("target_uri", ignorenulls=True).alias("__target"),
        F.first("date", ignorenulls=True).alias("__date"),
    )
    joined = answers.join(beside, "capture_id", "full_outer")
    return joined.select("capture_id", F.coalesce("target_uri", "__target").alias("target_uri"), F.coalesce("date", "__date").alias("date"), "request", "response", "metadata")


def digests(captured: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture with a response;
    a revisit takes them from the stored record with its payload digest."""
    body = F.col("response.payload")
    own = captured.where(F.col("response").isNotNull()).select(
        F.col("metadata")["page-id"].cast("long").alias("page_id"),
        F.col("response.warc_type").alias("record_type"),
        F.col("response.payload_digest").alias("__key"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body).alias("payload_digest"),
    )
    own = cut(own, "captures")
    again = own.where("record_type = 'revisit'").select("page_id", "record_type", "__key")
    wanted = again.select("__key").distinct()
    stored = own.where("record_type = 'response'").join(wanted, "__key", "left_semi")
    stored = cut(stored.groupBy("__key").agg(F.max("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest")), "referred")
    found = again.join(small_side(stored, 160), "__key", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain = own.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return plain.select(*columns).unionByName(found.select(*columns))
