"""WARC archives from pages by way of the legacy ARC format, and back to rows.

``pages_to_arc`` packs pages into ARC archives (version 1 or 2 header lines).
``arc_to_warc`` is the converter: it reads each archive's version block, parses the
header line that the version prescribes, takes as many bytes as the line declares,
verifies a version 2 checksum, and synthesises what a WARC record needs and ARC lacks:
record id, W3C timestamp, type and digests. The version block becomes a warcinfo record,
HTTP and DNS answers become responses of their own media types, and whatever else an
archive holds becomes a resource. ``mark_revisits`` finds equal payloads over the whole table by digest;
``write_warc`` writes real WARC files with Spark's own writer, so any file system that
Spark writes will do, and ``read_warc`` parses them again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Filter, cleaned, settle

CAPTURED = "20240101000000"
#: Payloads of fewer bytes are always written whole.
REVISIT_BYTES = 1000
ARC_BYTES = 8 << 20
#: Size that a WARC file is closed at; only a single record can make one larger.
FILE_BYTES = 8 << 20
#: Bytes that are handed to the decompressor at once.
STEP = 1 << 16

# Fixed values of the two archive formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HTTP_TYPE, DNS_TYPE, FIELDS_TYPE = "application/http; msgtype=response", "text/dns", "application/warc-fields"

RECORD_COLUMNS = "page_id long, record_id string, uri string, date string, record_type string, content_type string, payload_digest string, payload_bytes long, http binary, payload binary"


def record_uuid(page_id: int | None, content: bytes) -> str:
    """A version 8 UUID that holds the page id; without an id, one named by the content."""
    if page_id is None:
        return str(uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(content).hexdigest()))
    n = page_id & (1 << 64) - 1
    return str(uuid.UUID(int=(n >> 16) << 80 | 8 << 76 | (n >> 4 & 0xFFF) << 64 | 2 << 62 | (n & 15) << 58))


def page_of(record_id: str) -> int | None:
    """The page id in a record id of ``record_uuid``, None for another."""
    u = uuid.UUID(record_id).int
    if u >> 76 & 15 != 8:
        return None
    n = (u >> 80) << 16 | (u >> 64 & 0xFFF) << 4 | (u >> 58 & 15)
    return n - (1 << 64) if n >> 63 else n


def _http(page_id: int | None, payload: bytes) -> bytes:
    return (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()


def arc_record(version: int, url: str, body: bytes, offset: int, name: str, captured: str = CAPTURED) -> bytes:
    """One ARC record; blanks in a URL, which would break the header line, are percent-encoded."""
    url = quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "about:blank"
    fields = [url, "0.0.0.0", captured, "text/html"]
    if version == 2:
        fields += ["200", hashlib.md5(body).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_head(version: int, name: str, captured: str = CAPTURED) -> bytes:
    body = f"{version} 0 strandline\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", captured, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARC_BYTES) -> DataFrame:
    """``archive`` (binary): ARC archives of about ``archive_bytes``, versions 1 and 2 in turn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, filled, count = [], 0, 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(k) for k in range(3))):
                if not parts:
                    version, name = count % 2 + 1, f"part-{count}.arc"
                    parts, filled = [head := arc_head(version, name)], len(head)
                payload = (html.as_py() or "").encode("utf-8")
                parts.append(arc_record(version, url.as_py() or "", _http(page_id.as_py(), payload) + payload, filled, name))
                filled += len(parts[-1])
                if filled >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])
                    parts, count = [], count + 1
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "archive binary")


def parse_arc(data: bytes, described: bool = False) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record after the version block, and with ``described`` of that too.

    Raises ``ValueError`` on an unknown version, a malformed line, a short record or a body
    whose MD5 isn't the checksum that a version 2 line declares.
    """
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the separator after a body
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"ARC header line without an end at byte {at}")
        values = data[at:stop].decode("utf-8").split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"ARC header line without a length at byte {at}")
        body = data[stop + 1 : stop + 1 + int(values[-1])]
        if len(body) != int(values[-1]):
            raise ValueError(f"ARC record at byte {at} is shorter than its declared length")
        first = names is None
        if first:
            version = body.split(b" ", 1)[0]
            if not values[0].startswith("filedesc:") or version not in (b"1", b"2"):
                raise ValueError("not an ARC archive of version 1 or 2")
            names = ARC_FIELDS[int(version)].split(" ")
        if len(values) != len(names):
            raise ValueError(f"ARC header line has {len(values)} fields, {len(names)} expected")
        fields = dict(zip(names, values))
        if fields.get("Checksum", "-") not in ("-", hashlib.md5(body).hexdigest()):
            raise ValueError(f"checksum of the ARC record at byte {at}")
        at = stop + 1 + len(body)
        if described or not first:
            yield fields, body


def typed(fields: dict[str, str], body: bytes) -> tuple[str, str, bytes, bytes, dict[str, str]]:
    """What an ARC record becomes: WARC type, media type, HTTP head, payload and HTTP header fields."""
    scheme = fields["URL"].partition(":")[0].lower()
    if scheme == "filedesc":
        about = body.decode("utf-8", "replace").split("\n")[0]
        return "warcinfo", FIELDS_TYPE, b"", f"software: strandline\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC, {about}\r\n".encode(), {}
    if scheme == "dns":
        return "response", DNS_TYPE, b"", body, {}
    if body.startswith(b"HTTP/"):
        return "response", HTTP_TYPE, *split_http(body)
    return "resource", fields["Content-type"], b"", body, {}


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP head, payload and lower-cased header fields of a response block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("iso-8859-1").split("\r\n")[1:]
    return head + gap, payload, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _timestamp(arc_date: str) -> str:
    if not re.fullmatch(r"\d{14}", arc_date):
        raise ValueError(f"ARC date {arc_date!r}")
    y, mo, d, h, mi, s = arc_date[:4], *(arc_date[k : k + 2] for k in range(4, 14, 2))
    return f"{y}-{mo}-{d}T{h}:{mi}:{s}Z"


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """WARC records (``RECORD_COLUMNS``) of ARC archives in a column ``archive``, one for each of theirs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), *[(n, pa.string()) for n in ("record_id", "uri", "date", "record_type", "content_type", "payload_digest")], ("payload_bytes", pa.int64()), ("http", pa.binary()), ("payload", pa.binary())])
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for fields, body in parse_arc(archive.as_py() or b"", described=True):
                    kind, media, http, payload, headers = typed(fields, body)
                    named = headers.get("x-page-id", "")
                    page_id = int(named) if named else None
                    rows.append((page_id, record_uuid(page_id, fields["URL"].encode() + body), fields["URL"], _timestamp(fields["Archive-date"]), kind, media, hashlib.sha1(payload).hexdigest(), len(payload), http, payload))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select("archive").mapInArrow(run, RECORD_COLUMNS)


def mark_revisits(records: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``records`` with ``refers_to``: of responses with equal payloads that with the largest page id stays.

    Payloads are equal by SHA-1 and length. Records under ``least_bytes`` and records
    without a page id stay whole. ``records`` is read twice, so it should be settled.
    Groups are summed per task before the shuffle; only payloads that pass a filter of the
    repeated ones are moved, and the join can be split, so a payload that fills a third of
    the table is no hot spot. Rows that repeat the largest id of a group all stay responses.
    """
    groups = settle(
        records.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull() & (F.col("record_type") == "response"))
        .groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("first"), F.min("page_id").alias("other"))
        .where("first != other").drop("other")
    )
    names = records.columns
    key = F.xxhash64("payload_digest", "payload_bytes")
    known = Filter.of(groups, key)
    tested, hit = known.test(records, key) if known else (records, F.lit(True))
    again = F.col("payload_bytes").bitwiseXOR(F.lit(1))  # both sides are dealt anew, see common.dealt_anew
    met = (
        tested.where(hit).select(*names, again.alias("_size"))
        .join(groups.select("payload_digest", again.alias("_size"), "first"), ["payload_digest", "_size"], "left")
        .withColumn("refers_to", F.when((F.col("page_id") != F.col("first")) & (F.col("record_type") == "response"), F.col("first"))).select(*names, "refers_to")
    )
    alone = tested.where(~hit).select(*names, F.lit(None).cast("long").alias("refers_to"))
    return met.unionAll(alone).withColumn("record_type", F.when(F.col("refers_to").isNotNull(), F.lit("revisit")).otherwise(F.col("record_type")))


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"{WARC_VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def serialise(record: dict) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and refers to the record that has the payload."""
    headers = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{record['record_id']}>"), ("WARC-Date", record["date"])]
    block = record["http"]
    if record["record_type"] == "warcinfo":
        headers.append(("WARC-Filename", record["uri"].removeprefix("filedesc://")))
    else:
        headers += [("WARC-Target-URI", record["uri"]), ("WARC-Payload-Digest", _base32(record["payload_digest"]))]
    if record["record_type"] == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{record_uuid(record['refers_to'], b'')}>")]
    else:
        block += record["payload"]
    headers += [("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())), ("Content-Type", record["content_type"])]
    return warc_record(headers, block)


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own, the same bytes each time."""
    return gzip.compress(record, mtime=0)


def members(data: bytes) -> Iterator[bytes]:
    """The contents of concatenated gzip members, one after the other; zero bytes between them are skipped."""
    at = 0
    while at < len(data):
        if not data[at]:
            at += 1
            continue
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(data):
                raise ValueError("gzip member without an end")
            parts.append(inflate.decompress(data[at : at + STEP]))
            at = min(at + STEP, len(data)) - len(inflate.unused_data)
        yield b"".join(parts)


def write_warc(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Write WARC files into ``folder`` (it must not exist), in parallel, each record a gzip member.

    A file begins with a warcinfo record and is closed once it holds ``file_bytes``, so its
    size and the memory of a task are bounded by that and one record. Spark's text writer
    writes them, so any file system will do; the zero byte that it puts after a file is the
    end of the last member, whose uncompressed size has a zero there.
    """

    def closed(parts: list[bytes]) -> pa.RecordBatch:
        data = b"".join(parts)
        data = data if not data[-1] else data + member(b"")
        return pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.large_binary()).cast(pa.binary())], ["value"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, filled = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                if not parts:
                    named = uuid.uuid5(uuid.NAMESPACE_URL, row["record_id"])
                    about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{named}>"), ("WARC-Date", row["date"]), ("Content-Type", "application/warc-fields")]
                    parts = [member(warc_record(about, b"software: strandline\r\nformat: WARC File Format 1.1\r\n"))]
                parts.append(member(serialise(row)))
                filled += len(parts[-1])
                if filled >= file_bytes:
                    yield closed(parts)
                    parts, filled = [], 0
        if parts:
            yield closed(parts)

    (
        records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(folder)
    )


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record, by declared length."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at : max(stop, at)].decode("utf-8").split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        block = data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n
        if len(block) != n or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record before byte {at} does not have its declared length")
        at += 4
        yield headers, block


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, uri, payload_bytes, payload_digest, record_type, refers_to, payload`` of every response, revisit or resource.

    Block digests are verified, and payload digests of records that have their payload; a
    mismatch is a ``ValueError``. A revisit has no payload; its size is the one its HTTP head declares.
    """
    schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    plain = lambda x: base64.b32decode(x.removeprefix("sha1:")).hex()
    inner = lambda x: x.removeprefix("<urn:uuid:").removesuffix(">")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows = []
                for headers, block in chain.from_iterable(map(parse_warc, members(file.as_py()))):
                    if headers["warc-type"] not in ("response", "revisit", "resource"):
                        continue
                    if hashlib.sha1(block).hexdigest() != plain(headers["warc-block-digest"]):
                        raise ValueError(f"block digest of {headers['warc-record-id']}")
                    _, payload, http = split_http(block) if headers["content-type"] == HTTP_TYPE else (b"", block, {})
                    digest, whole = plain(headers["warc-payload-digest"]), headers["warc-type"] != "revisit"
                    if whole and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {headers['warc-record-id']}")
                    refers = headers.get("warc-refers-to")
                    rows.append((page_of(inner(headers["warc-record-id"])), headers["warc-target-uri"], len(payload) if whole else int(http["content-length"]), digest, headers["warc-type"], page_of(inner(refers)) if refers else None, payload if whole else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a WARC record per row of ``pages`` into ``folder`` and read the archives back.

    Null html is the empty payload, a null URL ``about:blank``; a null page id stays null
    and never names a response. Repeated rows are all written. Other columns are ignored
    whatever their names. An empty table writes no record and reads back no row.
    """
    with cleaned(pages.sparkSession):
        records = settle(arc_to_warc(pages_to_arc(pages, id_col, url_col, html_col)))
        write_warc(mark_revisits(records), folder)
    return read_warc(pages.sparkSession, folder)
