"""WARC archives: a writer with revisit records and a salvage reader.

Writing: each row becomes one record in a gzip member of its own; Spark's text writer puts
the members into `.warc.gz` files, so any file system that Spark writes to will do.  Of rows
with equal payloads of at least `min_revisit` bytes the one with the largest id is a
`response`, the others are `revisit` records that name it.

Reading: archives come in through Spark's binaryFile source and are walked in order.  Where a
member or record fails a check (gzip CRC or length, version line, header block, content
length, record end, payload digest) the reader searches for the next valid member or
version line, goes on from there, and logs the bytes between as a quarantined gap.

Scale: equal payloads are found by digest with a minimum row per digest (combined before
the shuffle); the join back is on the digest against digests that occur twice or more, and
its hot partitions can be split.  Archives are read whole, one at a time, so the writer bounds
their bytes: members go out in bundles of about `BUNDLE_BYTES`, of which a file holds
`BUNDLES_PER_FILE` at most.  Archives of others must be of sizes that a worker can hold.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, rename, texts_of, tidy

MIN_REVISIT_BYTES = 1000
#: Bytes of members in a bundle (or one larger member), and bundles in an archive at most.
BUNDLE_BYTES, BUNDLES_PER_FILE = 4 << 20, 16
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: An empty gzip member: it stands between records, where a text writer puts its line ends.
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_MAGIC = b"\x1f\x8b\x08"
_STEP = 8192
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")


def _header_value(text: str | None) -> str:
    """A value on one header line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text or "")


def _record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One uncompressed WARC record."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: {_record_id(page_id)}")
    if url:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    lines += [f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class _Bad(Exception):
    """A failed check."""


def _parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record at an offset of plain WARC bytes, and where it ends."""
    version = _VERSION.match(data, at)
    if not version:
        raise _Bad("no version line")
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise _Bad("no end of headers")
    headers = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line and not colon:
            raise _Bad("bad header line")
        if line:
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdecimal():
        raise _Bad("no content length")
    begin, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise _Bad("no record end at content length")
    block = data[begin:stop]
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    digest = headers.get("warc-payload-digest", "")
    if digest.startswith("sha1:") and headers.get("warc-type") == "response" and hashlib.sha1(payload).hexdigest() != digest[5:].lower():
        raise _Bad("payload digest differs")
    return Record(at, headers, payload), stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The plain bytes of the gzip member at an offset, and where it ends."""
    unpacker = zlib.decompressobj(31)
    view, plain, end = memoryview(data), [], at
    try:
        while not unpacker.eof and end < len(data):  # in steps: what follows the member is copied at each
            plain.append(unpacker.decompress(view[end : end + _STEP]))
            end += _STEP
    except zlib.error as e:
        raise _Bad(f"gzip: {e}") from None
    if not unpacker.eof:
        raise _Bad("gzip: cut short")
    return b"".join(plain), min(end, len(data)) - len(unpacker.unused_data)


def _looks_like_member(data: bytes, at: int) -> bool:
    try:
        head = zlib.decompressobj(31).decompress(data[at : at + 512], 5)
    except zlib.error:
        return False
    return head in (b"WARC/", b"")


def _next_start(data: bytes, at: int) -> int:
    """The next offset at which a member or a version line may begin, or the end."""
    version = _VERSION.search(data, at)
    stop = version.start() if version else len(data)
    while 0 <= (m := data.find(_MAGIC, at, stop)) < stop:
        if _looks_like_member(data, m):
            return m
        at = m + 1
    return stop


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of an archive, in order; every byte belongs to one of them.

    Members and plain records may be mixed.  A member whose bytes hold several records, or a
    record and junk, gives those that pass; the member is a gap for the rest.  Offsets are of
    the archive; a record inside a member has its member's offset.  Empty members are padding.
    """
    at = gap = 0
    reason = ""

    def failed(why: str) -> None:
        nonlocal reason
        reason = reason or why

    while at < len(data):
        good: list[Record] = []
        end = at
        try:
            if data.startswith(_MAGIC, at):
                plain, end = _member(data, at)
                inner, broken = 0, ""
                while inner < len(plain):
                    try:
                        record, inner = _parse(plain, inner)
                        good.append(Record(at, record.headers, record.payload))
                    except _Bad as e:
                        broken = broken or str(e)
                        found = _VERSION.search(plain, inner + 1)
                        inner = found.start() if found else len(plain)
                if broken and not good:
                    raise _Bad(broken)
                if broken:
                    yield Gap(at, end, broken)
            else:
                record, end = _parse(data, at)
                good.append(record)
        except _Bad as e:
            failed(str(e))
            at = _next_start(data, at + 1)
            continue
        if gap < at:
            yield Gap(gap, at, reason or "junk")
        reason = ""
        yield from good
        gap = at = end
    if gap < len(data):
        yield Gap(gap, len(data), reason or "junk")


def with_record_types(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url", min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to); refers_to is null for responses.

    A null html is an empty payload.  Rows with a null id are responses and nothing refers to
    them.  Repeated rows with the largest id of their payload are all responses.
    """
    data = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    own = pages.select(F.col(page_id).alias("page_id"), (F.col(url) if url in pages.columns else F.lit(None).cast("string")).alias("url"), F.col(html).alias("html"), F.octet_length(data).cast("long").alias("payload_bytes"), F.sha1(data).alias("payload_digest"))
    digests = pages.select(F.col(page_id).alias("i"), F.octet_length(data).alias("n"), F.sha1(data).alias("payload_digest")).where(F.col("n") >= min_revisit)
    first = digests.groupBy("payload_digest").agg(F.max("i").alias("response"), F.count("i").alias("rows")).where("rows > 1").drop("rows")
    joined = own.join(first, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") < F.col("response"), F.col("response"))).drop("response")


def write_warc(records: DataFrame, path: str, bundle_bytes: int = BUNDLE_BYTES, bundles_per_file: int = BUNDLES_PER_FILE) -> None:
    """Write the rows of `with_record_types` to `.warc.gz` files under `path`; an empty table gives no archive."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                columns = (part.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "payload_digest"))
                for i, url, refers, digest, data in zip(*columns, texts_of(part, "html"), strict=True):
                    member = gzip_member(record_bytes(i, url, data or b"", digest, refers))
                    if held and size + len(member) > bundle_bytes:
                        yield bundle(held)
                        held, size = [], 0
                    held.append(member)
                    size += len(member)
        if held:
            yield bundle(held)

    def bundle(members):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["bundle"])

    bundles = records.mapInArrow(tidy(run), "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    writer = bundles.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1"))
    writer.option("maxRecordsPerFile", bundles_per_file).text(path)
    rename(records.sparkSession, path, ".txt", ".warc.gz")


_COLUMNS = "archive string, offset long, gap_end long, gap_reason string, page_id long, record_type string, url string, refers_to long, payload_digest string, payload_bytes long"


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each record and each quarantined gap of the archives under `path`.

    Gaps have gap_end and gap_reason (null for records).  With `payload`, a binary column
    holds each response's payload (null for revisits and gaps).
    """

    def number(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                rows: list[list] = []
                for x in salvage(data):
                    if isinstance(x, Gap):
                        rows.append([name, x.start, x.end, x.reason, *[None] * 6, None])
                    else:
                        h = x.headers
                        kind, size = h.get("warc-type"), h.get("x-payload-bytes", "")
                        refers = number(h.get("warc-refers-to"))
                        rows.append([name, x.offset, None, None, number(h.get("warc-record-id")), kind, h.get("warc-target-uri"), refers, h.get("warc-payload-digest", "").removeprefix("sha1:"), int(size) if kind == "revisit" and size.isdecimal() else len(x.payload), x.payload if kind == "response" else None])
                    if len(rows) >= 1000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _COLUMNS.split(", ")] + ["payload"]
    width = len(names) if payload else len(names) - 1

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))[:width]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[:width])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content")
    return files.mapInArrow(tidy(run), _COLUMNS + (", payload binary" if payload else ""))


def remove_archives(spark: SparkSession, path: str) -> None:
    drop_path(spark, path)
