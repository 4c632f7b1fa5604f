"""WARC archives: a writer that refers to payloads it has stored already, and a reader that salvages damaged files.

The reader checks each member and record: the gzip checksum, the header, the
length, the end of the block, and the digests. Where a check fails it searches
for the next place at which a valid member or version line begins, goes on
from there, and logs the bytes between as quarantined. Within a gzip member it
does the same over what can be decompressed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismara.llm.shared import new_path, stored

#: Smaller payloads are stored each time.
LEAST_SHARED = 1000
#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 8 << 20
#: Payloads met more than once are broadcast up to this number; beyond, both sides of the join are shuffled.
BROADCAST_SHARED = 200_000
LEVEL = 4
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_SPEEDS = (b"\0", b"\2", b"\4")
_NOT_ZERO = re.compile(rb"[^\0]")
#: The smallest gzip member; in fewer zero bytes nothing can be lost.
LEAST_MEMBER = 20
_FIRST, _FEED = 64, 16_384
_KINDS = {"warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation"}


@dataclass(frozen=True)
class Record:
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


@dataclass(frozen=True)
class Gap:
    offset: int
    length: int
    reason: str


class Damaged(ValueError):
    """``until``: version lines up to there fail for the same reason, since they share the header lines that do."""

    def __init__(self, reason: str, until: int = 0):
        super().__init__(reason)
        self.until = until


def record_bytes(kind: str, record_id: str, block: bytes, headers: list[tuple[str, str]]) -> bytes:
    """One record, uncompressed."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *headers, ("WARC-Block-Digest", "sha1:" + hashlib.sha1(block).hexdigest()), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A record as a gzip member of its own."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def _digest_fits(said: str, data: bytes) -> bool:
    name, _, value = said.partition(":")
    if name.lower() != "sha1":
        return True  # nothing to hold it against
    own = hashlib.sha1(data)
    return value.lower() == own.hexdigest() or value.upper() == base64.b32encode(own.digest()).decode()


def _parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at ``at``; raises Damaged."""
    version = _VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    headers: dict[str, str] = {}
    line_at = version.end()
    while True:  # line by line, so that a false version line costs no more than its first bad line
        line_end = data.find(b"\r\n", line_at)
        if line_end < 0:
            raise Damaged("no end of the header", len(data))
        if line_end == line_at:
            break
        name, colon, value = data[line_at:line_end].partition(b":")
        if not colon:
            raise Damaged("a header line without a name", line_at)
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        line_at = line_end + 2
    if not re.fullmatch(r"\d{1,18}", headers.get("content-length", "")):
        raise Damaged("no length", line_at)
    start = line_at + 2
    end = start + int(headers["content-length"])
    if end > len(data):
        raise Damaged("the block is cut", line_at)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where it should", line_at)
    block = data[start:end]
    if not _digest_fits(headers.get("warc-block-digest", ""), block):
        raise Damaged("the block has another digest")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        _, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise Damaged("the block has no end of the HTTP header")
    if headers.get("warc-type") in ("response", "resource") and not _digest_fits(headers.get("warc-payload-digest", ""), payload):
        raise Damaged("the payload has another digest")
    return headers, payload, end + 4


def _member_at(data: memoryview, at: int) -> tuple[bytes, int, str, bool]:
    """What can be decompressed of the gzip member at ``at``, its end, why it is not whole (else empty), and whether it is cut only."""
    d, parts, fed = zlib.decompressobj(31), [], min(len(data), at + _FIRST)
    try:
        parts.append(d.decompress(data[at:fed]))
    except zlib.error:
        return b"", fed, "the member cannot be decompressed", False  # too little to hold a record
    try:
        while not d.eof:
            if fed >= len(data):
                return b"".join(parts), fed, "the member is cut", True
            parts.append(d.decompress(data[fed : fed + _FEED]))
            fed = min(len(data), fed + _FEED)
    except zlib.error:
        # A call that fails returns nothing, so the last piece is fed again in halves up to the byte that fails.
        d = zlib.decompressobj(31)
        parts = [d.decompress(data[at:fed])]
        step, end = _FEED, min(len(data), fed + _FEED)
        while step and fed < end:
            tried = d.copy()
            try:
                parts.append(tried.decompress(data[fed : min(end, fed + step)]))
            except zlib.error:
                step //= 2
                continue
            d, fed = tried, min(end, fed + step)
        return b"".join(parts), fed, "the member cannot be decompressed", False
    return b"".join(parts), fed - len(d.unused_data), "", False


def _guarded(headers: dict[str, str]) -> bool:
    """Whether a record stands without its member's checksum: its block has a digest, which fitted, and its header says what it should."""
    kind = headers.get("warc-type")
    fits = headers.get("warc-block-digest", "").lower().startswith("sha1:") and kind in _KINDS
    return fits and (kind != "response" or headers.get("content-type", "").startswith("application/http"))


def _held(held: bytes, guarded: bool) -> tuple[list[tuple[dict[str, str], bytes]], str]:
    """The valid records of decompressed bytes, and why the first bytes between them were given up (else empty)."""
    found, at, reason = [], 0, ""
    while at < len(held):
        try:
            headers, payload, end = _parsed(held, at)
            if guarded and not _guarded(headers):
                raise Damaged("nothing guards the record")
        except Damaged as e:
            reason = reason or str(e)
            at = held.find(b"WARC/1.", max(at + 1, e.until))
            if at < 0:
                break
            continue
        found.append((headers, payload))
        at = end
    return found, reason


def _at(data: bytes, view: memoryview, at: int) -> tuple[list[Record], int, str]:
    """The records at ``at``, of a gzip member or plain, their end, and what the member lacks (else empty); raises Damaged if there are none.

    The end of a member that cannot be decompressed is not known; it is ``at``.
    """
    if data.startswith(_MEMBER, at):
        held, end, broken, cut = _member_at(view, at)
        found, reason = _held(held, guarded=bool(broken) and not cut)
        if not found:
            raise Damaged(broken or reason or "an empty member")
        return [Record(at, end - at, h, p) for h, p in found], at if broken else end, broken or reason
    headers, payload, end = _parsed(data, at)
    return [Record(at, end - at, headers, payload)], end, ""


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The valid records of an archive in order, and the bytes between them that were given up.

    A member of which only some records are valid gives those, and a gap over
    its bytes. Fewer than LEAST_MEMBER zero bytes between members or at the
    end are padding, more are a gap. An empty archive has neither records nor
    gaps.
    """
    view, at, size = memoryview(data), 0, len(data)
    found = None
    # Where the next of each begins; what was found is remembered until it is passed, so nothing is searched twice.
    ahead = {_MEMBER: -2, b"WARC/1.": -2}
    while at < size:
        if found is None and not data[at]:
            to = m.start() if (m := _NOT_ZERO.search(data, at)) else size
            if to - at >= LEAST_MEMBER:
                yield Gap(at, to - at, "zero bytes")
            at = to
            continue
        until = 0
        try:
            records, end, reason = found or _at(data, view, at)
        except Damaged as e:
            records, end, reason, until = [], at, str(e), e.until
        found = None
        if end > at:
            yield from records
            if reason:
                yield Gap(at, end - at, reason)
            at = end
            continue
        after = at + 1
        while found is None:
            for mark, place in ahead.items():
                least = max(after, until) if mark != _MEMBER else after
                if place != -1 and place < least:
                    ahead[mark] = data.find(mark, least)
            places = [p for p in ahead.values() if p >= 0]
            if not places:
                break
            after = min(places) + 1
            if data.startswith(_MEMBER, after - 1) and (data[after + 2 : after + 3] > b"\x1f" or data[after + 7 : after + 8] not in _SPEEDS):
                continue  # flags or a speed that gzip does not have
            try:
                found = _at(data, view, after - 1)
            except Damaged as e:
                until = max(until, e.until)
        to = size if found is None else after - 1
        yield from (Record(at, to - at, r.headers, r.payload) for r in records)
        yield Gap(at, to - at, reason)
        at = to


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``archive`` binary: gzip-compressed WARC archives of all pages, a member for each record.

    The payload is the html in UTF-8, empty if null. Of records with equal
    payloads of LEAST_SHARED bytes or more, that with the largest id is a
    response and the others revisit it; so rows that share that id are all
    responses, and so are rows of which none has an id. A null url is left
    out; space and control characters of a url are percent-encoded.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    shared = rows.where(F.col("n") >= LEAST_SHARED).groupBy(F.col("digest").alias("d")).agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    shared, _ = stored(shared, "shared")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_SHARED else shared
    rows = rows.join(shared, F.col("digest") == F.col("d"), "left").select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def closed() -> pa.RecordBatch:
            info = member(record_bytes("warcinfo", "urn:prismara:info", b"format: WARC File Format 1.0\r\n", [("Content-Type", "application/warc-fields")]))
            return pa.RecordBatch.from_arrays([pa.array([info + b"".join(parts)], pa.binary())], names=["archive"])

        for batch in batches:
            for id_, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                id_, url, payload, digest, refers_to = (x.as_py() for x in (id_, url, payload, digest, refers_to))
                headers = [("WARC-Target-URI", _clean(url))] * (url is not None)
                headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
                if refers_to is None:
                    record = record_bytes("response", f"urn:page:{'' if id_ is None else id_}", http + payload, headers)
                else:
                    headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")]
                    record = record_bytes("revisit", f"urn:page:{'' if id_ is None else id_}", http, headers)
                parts.append(member(record))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    parts, size = [], 0
        if parts:
            yield closed()

    return rows.mapInArrow(work, "archive binary")


def write_archives(archives: DataFrame, path: str) -> None:
    """Each archive as a file below ``path``, on any storage that Spark writes to; a zero byte, gzip's padding, ends it."""
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path`` as ``path``, ``content``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def salvaged(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of archives (``path``, ``content``).

    Columns: ``path``, ``offset``, ``length`` (of the member or record, or of
    the bytes given up), ``gap`` (why, else null), ``record_type``,
    ``record_id``, ``target_uri``, ``refers_to``, ``payload_digest`` (SHA-1 in
    hex, or as said by a revisit), ``payload_bytes`` and ``payload`` (null for
    revisits, whose payload is in the record they refer to; see
    :func:`resolved`). Null contents have no rows. Spark reads files of up to
    2 GB whole; larger archives must be split between members: of a member that
    a cut runs through, records behind the cut are lost with it.
    """
    names = ["path", "offset", "length", "gap", "record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * with_payload
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64()] + [pa.binary()] * with_payload

    def row(path: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return (path, x.offset, x.length, x.reason, *[None] * (len(names) - 4))
        h, revisit = x.headers, x.headers.get("warc-type") == "revisit"
        digest = h.get("warc-payload-digest", "").partition(":")[2].lower() if revisit else hashlib.sha1(x.payload).hexdigest()
        said = h.get("warc-payload-length", "")
        n = (int(said) if said.isdigit() else None) if revisit else len(x.payload)
        bare = {k: h[k].strip("<>") if k in h else None for k in ("warc-record-id", "warc-refers-to")}
        return (path, x.offset, x.length, None, h.get("warc-type"), bare["warc-record-id"], h.get("warc-target-uri"), bare["warc-refers-to"], digest, n) + (None if revisit else x.payload,) * with_payload

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                size = 0
                for x in salvage(content.as_py() or b""):
                    rows.append(row(path.as_py(), x))
                    size += x.length
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(work, "path string, offset long, length long, gap string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long" + ", payload binary" * with_payload)


def resolved(found: DataFrame) -> DataFrame:
    """Records (see :func:`salvaged`) with the length and digest of each revisit's payload taken from the response it refers to, and ``dangling``: that response is not there."""
    is_revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    revisits, others = found.where(is_revisit), found.where(~is_revisit)
    asked = revisits.where("refers_to is not null").select(F.col("refers_to").alias("r_id")).distinct()
    responses = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("r_id")).agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("r"))
    targets, _ = stored(asked.join(responses, "r_id"), "targets")
    targets = F.broadcast(targets) if targets.count() <= BROADCAST_SHARED else targets
    # Only revisits meet targets; all other records stay where they are.
    met = revisits.join(targets, F.col("refers_to") == F.col("r_id"), "left").withColumns({c: F.col(f"r.{c}") for c in ("payload_bytes", "payload_digest")})
    met = met.withColumn("dangling", F.col("r_id").isNull()).drop("r_id", "r")
    return met.unionByName(others.withColumn("dangling", F.lit(False)))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder and read those back.

    Columns: ``id_col``, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to``. One row for each input row. Null html is
    an empty payload; ids may be null or repeated, see :func:`archives`.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(archives(pages, id_col, url_col, html_col), path)
    found = salvaged(read_archives(spark, path), with_payload=False).where("record_type in ('response', 'revisit')")
    found, _ = stored(found.select("record_type", "record_id", "refers_to", "payload_digest", "payload_bytes"), "records")
    found = resolved(found)
    number = lambda c: F.expr(f"try_cast(substring({c}, length('urn:page:') + 1) as long)")
    kind = pages.schema[id_col].dataType
    return found.select(number("record_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to").cast(kind).alias("refers_to"))
