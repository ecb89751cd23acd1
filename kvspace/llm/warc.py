"""WARC archives: a writer, and a reader that salvages what it can.

The reader takes records one after the other. When a member does not inflate, a version line
or length is wrong, or a digest does not match, it looks for the next gzip member or version
line that does hold, goes on there, and logs the bytes between as a quarantined gap. The same
is done inside a member of several records, and with what inflates of a damaged member before
it breaks off; records and gaps of one member all have the member's offset. No record after a
damaged one is lost, except in the part of a gzip member that no longer inflates, and every
byte of an archive lies in a record or a gap.

A record of a member that fails its checksum or is cut short has the member's failure as its
reason: its block matches its digest, its headers could not be checked. Without a digest its
kind is "unverified".

Null html counts as an empty payload, a null url as an empty one. Rows that repeat a page_id
with an equal payload of the largest page_id are all responses. Payloads of any length are
written and read whole. An empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspace.llm.store import materialize
from kvspace.llm.urls import MAX_LISTED, build_filter, maybe_listed

#: Bytes of an archive before the next one begins; a reader's task holds one archive.
ARCHIVE_BYTES = 4 << 20
#: The least payload that is replaced by a revisit.
REVISIT_BYTES = 1000
#: Compressed bytes that are inflated at a time.
BLOCK = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
_MEMBER = b"\x1f\x8b\x08"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, uri: str, payload: bytes, refers_to: str | None = None, compress: bool = True) -> bytes:
    """One record; a revisit has the payload's digest and length but not the payload."""
    block = _HTTP + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '', uri)}",
        f"WARC-Payload-Digest: {_base32(payload)}",
        f"WARC-Block-Digest: {_base32(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return data
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Found:
    """A record (kind "record" or "unverified"), or a span of bytes that holds none ("gap"); offset and length are in the archive's bytes."""

    kind: str
    offset: int
    length: int
    reason: str = ""
    headers: dict[str, str] | None = None
    payload: bytes = b""


#: Headers end with an empty line; a version line before it begins another record, so no byte is searched twice.
_HEADERS_END = re.compile(rb"\r?\n\r?\n|\n(WARC/[0-9]+\.[0-9]+\r?\n)")


def _plain(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """The record at ``at`` of uncompressed bytes: headers, block, end; or why there is none."""
    m = _VERSION.match(data, at)
    if not m:
        return "no version line"
    stop = _HEADERS_END.search(data, m.end() - 2)
    if not stop or stop[1]:
        return "headers do not end"
    headers = {}
    for line in data[m.end() : stop.start()].decode("utf-8", "replace").splitlines():
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    size = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,15}", size):
        return "no content length"
    end = stop.end() + int(size)
    if end > len(data):
        return "block is cut short"
    tail = re.compile(rb"\r?\n\r?\n").match(data, end)
    if not tail:
        return "no end after the block"
    block = data[stop.end() : end]
    digest = headers.get("warc-block-digest", "")
    if digest.lower().startswith("sha1:") and digest.upper() != _base32(block).upper():
        return "block digest does not match"
    return headers, block, tail.end()


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    if "application/http" in headers.get("content-type", ""):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str, bool]:
    """One gzip member: its content as far as it inflates, its end or where it broke off, why it fails, whether all content came out.

    zlib checks the CRC and length. The block in which an error lies is inflated again byte by
    byte, so that all that comes out before the error is kept.
    """
    z, out, k = zlib.decompressobj(31), [], at
    while not z.eof and k < len(data):
        before = z.copy()
        try:
            out.append(z.decompress(data[k : k + BLOCK]))
            k = min(k + BLOCK, len(data))
        except zlib.error:
            try:
                while True:
                    out.append(before.decompress(data[k : k + 1]))
                    k += 1
            except zlib.error as e:
                trailer = re.search("incorrect (data|length) check", str(e))  # told at its fourth or eighth byte, which may be the next member's
                end = k - {"data": 3, "length": 7}[trailer[1]] if trailer else k
                return b"".join(out), end, f"member does not inflate: {e}", trailer is not None
    if not z.eof:
        return b"".join(out), k, "member is cut short", False
    return b"".join(out), k - len(z.unused_data), "", True


def _content(body: bytes, damage: str) -> list[tuple[str, str, dict[str, str] | None, bytes]]:
    """(kind, reason, headers, block) of all records and gaps of a member's content; damage is why the member fails."""
    out, k = [], 0
    while k < len(body):
        one = _plain(body, k)
        if isinstance(one, str):
            out.append(("gap", one, None, b""))
            while isinstance(one, str):
                m = _VERSION.search(body, k + 1)
                if not m:
                    return out
                k = m.start()
                one = _plain(body, k)
        headers, block, k = one
        checked = not damage or headers.get("warc-block-digest", "").lower().startswith("sha1:")
        out.append(("record" if checked else "unverified", damage, headers, block))
    return out


def _records_of(data: bytes, at: int) -> tuple[list[tuple[str, str, dict[str, str] | None, bytes]], int, str]:
    """What the member or plain record at ``at`` holds, its end, and why it breaks off there ("" if it does not)."""
    if data[at : at + 3] == _MEMBER:
        body, end, damage, all_out = _inflate(data, at)
        items = _content(body, damage)
        if damage and all(kind == "gap" for kind, *_ in items):
            return [], at, damage
        return items, end, "" if all_out else damage
    one = _plain(data, at)
    if isinstance(one, str):
        return [], at, one
    return [("record", "", *one[:2])], one[2], ""


_START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]+\.[0-9]+\r?\n")


def salvage(data: bytes) -> Iterator[Found]:
    at, got = 0, None
    while at < len(data):
        begin = at
        items, end, broken = got or _records_of(data, at)
        got = None
        for kind, reason, headers, block in items:
            yield Found(kind, begin, end - begin, reason, headers, _payload(headers, block) if headers else b"")
        at = end
        if broken:
            # the next member or version line that holds; bytes that a broken member has taken in may belong to it
            next_ = begin
            while got is None:
                m = _START.search(data, next_ + 1)
                if not m:
                    next_ = len(data)
                    break
                next_ = m.start()
                found = _records_of(data, next_)
                got = found if found[0] else None
            gap = min(end, next_)
            if next_ > gap or not items:
                yield Found("gap", gap, next_ - gap, broken)
            at = next_


_RECORD = "archive string, kind string, offset long, length long, reason string, warc_type string, record_id string, uri string, refers_to string, digest_header string, length_header long, payload binary"


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps of (archive, content); payloads are the bytes read back."""

    def run(batches):
        names = [c.split()[0] for c in _RECORD.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column("archive")[i].as_py(), [], 0
                for f in salvage(batch.column("content")[i].as_py() or b""):
                    h = f.headers or {}
                    strip = lambda k, h=h: h[k].strip("<>") if k in h else None
                    size = h.get("x-payload-length", "")
                    rows.append((name, f.kind, f.offset, f.length, f.reason, h.get("warc-type"), strip("warc-record-id"), h.get("warc-target-uri"), strip("warc-refers-to"), h.get("warc-payload-digest"), int(size) if size.isdigit() else None, f.payload if f.headers else None))
                    held += len(f.payload)
                    if held > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select("archive", "content").mapInArrow(run, _RECORD)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of WARC files, compressed or not, each of a size that a task can hold."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"))


def gap_log(found: DataFrame) -> DataFrame:
    """(archive, offset, length, reason) of the quarantined spans of what a reader has found."""
    return found.filter("kind = 'gap'").select("archive", "offset", "length", "reason")


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, content): the pages as archives of compressed records, in a table of the shared folder.

    Payloads that are large enough and repeated are found by their digests alone. A Bloom
    filter of these digests, of bounded size, keeps all other pages out of the join.
    """
    html = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    sized = sized.withColumn("key", F.when(F.octet_length("html") >= REVISIT_BYTES, F.xxhash64("digest")))
    copies = materialize(sized.filter("key IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"), "copies")
    words = build_filter(copies.select(F.xxhash64("digest").alias("key")), min(copies.count(), MAX_LISTED))
    tested = sized.withColumn("maybe", maybe_listed(F.col("key"), words, pages.sparkSession))
    again = tested.filter("maybe").join(copies, "digest", "left")
    known = tested.filter("NOT maybe").withColumn("first", F.lit(None).cast(copies.schema["first"].dataType)).unionByName(again)

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        content = bytearray()

        def full():
            nonlocal content, number
            out = pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{number:06d}.warc.gz"]), pa.array([bytes(content)], pa.binary())], names=["archive", "content"])
            content, number = bytearray(), number + 1
            return out

        for batch in batches:
            ids, urls, pages, firsts = (batch.column(c) for c in ("page_id", "url", "html", "first"))
            for i in range(batch.num_rows):
                page, first = ids[i].as_py(), firsts[i].as_py()
                kind = "response" if first is None or first == page else "revisit"
                content += record(kind, f"urn:page:{page}", urls[i].as_py(), pages[i].as_py().encode(), None if kind == "response" else f"urn:page:{first}")
                if len(content) >= ARCHIVE_BYTES:
                    yield full()
        if content:
            yield full()

    return materialize(known.select("page_id", "url", "html", "first").mapInArrow(run, "archive string, content binary"), "warc")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages, reads them back, and tells what was read of each."""
    got = read_archives(write_archives(pages)).filter("kind = 'record'")
    number = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    response = F.col("warc_type") == "response"
    b32 = F.substring_index("digest_header", ":", -1)
    return got.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("length_header")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(_hex_of_base32(b32)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(~response, number("refers_to")).alias("refers_to"),
    )


def _hex_of_base32(c):
    """Lower-case hex of a 32-sign base-32 digest: each sign is five bits, each four bits a hex sign."""
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = lambda i: F.lpad(F.bin(F.instr(F.lit(signs), F.substring(c, i, F.lit(1))) - 1), 5, "0")
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32)), five), "")
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.conv(F.substring(bits, i * 4 + 1, F.lit(4)), 2, 16)), ""))
