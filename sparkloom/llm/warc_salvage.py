"""WARC archives: write pages as response and revisit records, read them back, salvage damaged files.

The reader trusts nothing: a record counts only if its version line, length, end mark and digests
hold (digests of an unknown algorithm or encoding are not checked).  After a failed check it looks for
the next version line or gzip member that does hold, so later records are recovered, and logs the
bytes between as a quarantined gap.  Of a gzip member every record that holds counts, and of a broken
member those of the part that can be unpacked; its records and its gap have the member's place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.store import delete_at_end, fresh_path, materialize

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_ALGORITHMS = ("md5", "sha1", "sha256", "sha384", "sha512")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def format_record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record with its end mark; a revisit carries the headers of its payload only."""
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head += [f"WARC-Record-ID: <urn:page:{page_id}>"]
    if url is not None:
        head += [f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def declared_digest(text: str) -> tuple[str, bytes] | None:
    """(algorithm, digest) of a labelled digest; None if the algorithm or the encoding is unknown."""
    name, colon, value = text.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip().rstrip("=")
    if not colon or name not in _ALGORITHMS:
        return None
    size = hashlib.new(name).digest_size
    try:
        if len(value) == 2 * size:
            return name, bytes.fromhex(value)
        if len(value) == -(-size * 8 // 5):
            return name, base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return name, b""  # the right length with a damaged letter: equal to no digest
    return None


def _differs(declared: str | None, raw: bytes) -> bool:
    known = declared_digest(declared or "")
    return known is not None and hashlib.new(known[0], raw).digest() != known[1]


class Damaged(ValueError):
    """A record that fails a check.  Its length is not trusted either: the next one is searched for."""


def parse_record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the uncompressed record at `at`; Damaged if a check fails."""
    version = _VERSION.match(raw, at)
    if not version:
        raise Damaged("no version line")
    stop = raw.find(b"\r\n\r\n", version.end() - 2)
    if stop < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in raw[version.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no length")
    begin, end = stop + 4, stop + 4 + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no end mark")
    block = raw[begin:end]
    if _differs(headers.get("warc-block-digest"), block):
        raise Damaged("block digest")
    head, blank, payload = block.partition(b"\r\n\r\n")
    if not blank:
        payload = block
    if headers.get("warc-type") == "response" and _differs(headers.get("warc-payload-digest"), payload):
        raise Damaged("payload digest")
    return headers, payload, end + 4


def _member(raw: bytes, at: int) -> tuple[bytes, int, str]:
    """(content, end, "") of the gzip member at `at`; of a broken one the part that can be unpacked,
    where it breaks and why."""
    unzip, parts, view, step = zlib.decompressobj(31), [], memoryview(raw), 1 << 16
    while not unzip.eof and at < len(raw):
        before = unzip.copy() if step > 1 else None
        try:
            parts.append(unzip.decompress(view[at : at + step]))
        except zlib.error as e:
            if before is None:
                return b"".join(parts), at, f"gzip: {e}"
            unzip, step = before, 1  # an error drops what its piece gave: byte by byte up to it
            continue
        at += step
    if not unzip.eof:
        return b"".join(parts), len(raw), "gzip member does not end"
    return b"".join(parts), min(at, len(raw)) - len(unzip.unused_data), ""


def _inner(content: bytes) -> tuple[list[tuple[dict[str, str], bytes]], str]:
    """(records that hold, first reason why others don't) of an unpacked member."""
    found, at, why = [], 0, ""
    while at < len(content):
        try:
            headers, payload, at = parse_record(content, at)
            found.append((headers, payload))
        except Damaged as e:
            m = _VERSION.search(content, at + 1)
            following = m.start() if m else len(content)
            if content[at:following].strip(b"\r\n"):
                why = why or str(e)
            at = following
    return found, why


def salvage(raw: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | str, bytes]]:
    """('record', start, end, headers, payload) and ('gap', start, end, reason, b'') in file order."""

    def search(at: int) -> int:
        m = _START.search(raw, at + 1)
        return m.start() if m else len(raw)

    at, bad, why = 0, None, ""
    held, until = [], 0  # records of the last broken member, and where it breaks: its bytes are searched again
    while at < len(raw):
        reason = ""
        if raw.startswith(b"\x1f\x8b", at):
            content, end, broken = _member(raw, at)
            found, reason = _inner(content)
            if at < until:
                found = [x for x in found if x not in held]
            if broken:
                reason = broken
                if found:
                    held, until = (held if at < until else []) + found, max(until, end)
                end = search(at)  # the next member may begin before the place where this one breaks
        else:
            found = []
            try:
                headers, payload, end = parse_record(raw, at)
                if at >= until or (headers, payload) not in held:
                    found = [(headers, payload)]
                else:
                    reason = "record of a broken member"
            except Damaged as e:
                end, reason = search(at), str(e)
        if not found and (reason or bad is not None):
            if bad is None:
                bad, why = at, reason
        else:
            if bad is not None:
                yield "gap", bad, at, why, b""
                bad = None
            for headers, payload in found:
                yield "record", at, end, headers, payload
            if reason:
                yield "gap", at, end, reason, b""
        at = end
    if bad is not None:
        yield "gap", bad, len(raw), why, b""


def _pack(archive_bytes: int, compress: bool):
    def go(batches):
        held, n = [], 0

        def blob():
            return pa.record_batch([pa.array([b"".join(held)], pa.binary())], names=["blob"])

        for batch in batches:
            ids, urls, bodies, shas, refers = (batch.column(k) for k in range(5))
            for k in range(batch.num_rows):
                payload = bodies[k].as_py() or b""
                digest = base64.b32encode(bytes.fromhex(shas[k].as_py())).decode()
                record = format_record(ids[k].as_py(), urls[k].as_py(), payload, digest, refers[k].as_py())
                if compress:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    record = z.compress(record) + z.flush()
                if held and n + len(record) > archive_bytes:
                    yield blob()
                    held, n = [], 0
                held.append(record)
                n += len(record)
        if held:
            yield blob()

    return go


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = 16 << 20, compress: bool = False) -> None:
    """One WARC file of about `archive_bytes` for each run of pages (a larger record has its own).

    Of records with equal payloads of at least min_bytes, the one with the smallest id is a response
    and those with larger ids revisit it.  A null payload is empty; rows that repeat that smallest id
    are responses too; a null id has no record id, revisits where another row of the group has an id,
    and is a response otherwise.  Pages of any length are one record each, and other columns of the pages
    are not looked at, whatever their names.  The files pass through Spark's text writer, so any store that
    Spark can write to will do.
    """
    raw = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), raw.alias("body"))
    rows = rows.withColumn("sha", F.sha1("body")).withColumn("same", F.sha2("body", 256))  # SHA-1 is declared, SHA-256 decides what is equal
    large = F.length("body") >= min_bytes
    shared = materialize(rows.where(large).select("same", "id").groupBy("same").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("same", "first"), "payloads")
    refers = F.when(large & F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))), F.col("first"))
    blobs = rows.join(shared, "same", "left").select("id", "url", "body", "sha", refers.alias("refers")).mapInArrow(_pack(archive_bytes, compress), "blob binary")
    # The writer ends each row with lineSep: the last two bytes of the record's own end mark.
    text = F.col("blob") if compress else F.expr("substring(blob, 1, length(blob) - 2)")
    blobs.select(text.cast("string").alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of kind 'record' and 'gap': path, start, end, page_id, url, record_type, payload_bytes,
    payload_digest (bare base32 SHA-1 of the full payload; null for a revisit that declares another), refers_to, payload and reason.

    Records that fail a check are not rows of kind 'record'; their bytes are in a gap with the reason.
    An empty folder gives no rows; an empty file gives none either.  A file is read whole by one task,
    so it has to fit in a worker: write_archives makes files of about 16 MB.
    """

    def go(batches):
        names = ("kind", "path", "start", "end", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "reason")
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())

        def number(text):
            m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
            return int(m[1]) if m else None

        def batch_of(rows):
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=list(names))

        for batch in batches:
            for k in range(batch.num_rows):
                where, rows = batch.column(0)[k].as_py(), []
                for kind, a, b, what, payload in salvage(batch.column(1)[k].as_py()):
                    if kind == "gap":
                        if what == "no version line" and b - a <= 2:
                            continue  # the writer's line end after a compressed member
                        rows.append((kind, where, a, b, None, None, None, None, None, None, None, what))
                        continue
                    h, kind_ = what, what.get("warc-type")
                    size = int(h["x-payload-length"]) if kind_ == "revisit" and h.get("x-payload-length", "").isdigit() else len(payload)
                    known = declared_digest(h.get("warc-payload-digest", ""))
                    digest = base64.b32encode(known[1]).decode() if known and known[0] == "sha1" else None if kind_ == "revisit" else sha1_base32(payload)
                    rows.append((kind, where, a, b, number(h.get("warc-record-id")), h.get("warc-target-uri"), kind_, size, digest, number(h.get("warc-refers-to")), payload, None))
                    if len(rows) >= 512:
                        yield batch_of(rows)
                        rows = []
                yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(
        go,
        "kind string, path string, start long, end long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, reason string",
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as archives in the shared folder and read all records back."""
    path = fresh_path(pages.sparkSession, "warc")
    delete_at_end(pages.sparkSession, path)
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
