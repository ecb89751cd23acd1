"""Ogg media columns.

Writing: a payload is cut into packets, packets into lacing values, and these into pages of
one or two logical streams; the granule position counts samples of 8 bits. Reading: every
page's checksum is verified, packets are put together from the lacing values over page
borders, streams are told apart by serial number, and times come from granule positions.

Null texts count as empty. Equal payloads give equal bytes. Texts of any length are stored
whole. Damaged pages are skipped, and packets that a lost page cuts are dropped; lost pages
and cut packets are counted. Repeated rows give repeated results, an empty table an empty
one. Added columns replace those of their names; others are kept or not as asked.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kvspace.llm.text import extend

#: Samples of 8 bits a second, and of a packet.
RATE = 8000
PACKET = 4096
_PAGE = struct.Struct("<4sBBqIIIB")
_BITS = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """Ogg's checksum: polynomial 0x04C11DB7 from the high bit, start 0.

    That is the mirror image of zlib's CRC over mirrored bytes with a start of 0.
    """
    mirrored = zlib.crc32(data.translate(_BITS), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_BITS), "big")


def write_stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream from (packet, granule position at its end)."""
    pages: list[bytes] = []
    lacing, body, granule, continued = bytearray(), bytearray(), -1, False

    def flush(last: bool, more: bool) -> None:
        nonlocal lacing, body, granule, continued
        flags = (1 if continued else 0) | (2 if not pages else 0) | (4 if last else 0)
        head = _PAGE.pack(b"OggS", 0, flags, granule, serial, len(pages), 0, len(lacing)) + lacing
        page = bytearray(head + body)
        page[22:26] = page_crc(bytes(page)).to_bytes(4, "little")
        pages.append(bytes(page))
        lacing, body, granule, continued = bytearray(), bytearray(), -1, more

    for k, (packet, at) in enumerate(packets):
        sizes = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
        done = 0
        while done < len(sizes):
            room = 255 - len(lacing)
            if not room:
                flush(False, done > 0)
                room = 255
            take = sizes[done : done + room]
            body += packet[done * 255 : done * 255 + sum(take)]
            lacing += take
            done += len(take)
        granule = at
        if not pages:  # the head packet has a page of its own
            flush(len(packets) == 1, False)
        elif k == len(packets) - 1:
            flush(True, False)
    if len(packets) > 1 and lacing:
        flush(True, False)
    return pages


def encode(payload: bytes) -> bytes:
    """Two multiplexed streams: 0 has the samples, 1 has a comment packet with their number."""
    serial = int.from_bytes(hashlib.blake2b(payload, digest_size=4).digest(), "little") & 0x7FFFFFFE
    head = b"PCM8" + struct.pack("<II", RATE, len(payload))
    packets = [(head, 0)] + [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    sound = write_stream(serial, packets)
    note = write_stream(serial | 1, [(b"NOTE" + struct.pack("<Q", len(payload)), 0)])
    return b"".join([sound[0], note[0], *sound[1:]])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    times: list[float] = field(default_factory=list)
    ended: bool = False
    open: bytearray | None = None
    page: int = 0
    lost: int = 0
    cut: int = 0


@dataclass
class Media:
    streams: dict[int, Stream]
    pages: int
    bad: int

    def samples(self) -> bytes:
        for s in self.streams.values():
            if s.packets and s.packets[0][:4] == b"PCM8":
                return b"".join(s.packets[1:])
        return b""


def decode(data: bytes) -> Media:
    streams: dict[int, Stream] = {}
    pages = bad = 0
    at = data.find(b"OggS")
    if at:
        bad += 1 if data else 0
    while 0 <= at < len(data):
        ok = False
        if at + 27 <= len(data):
            _, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            if version == 0 and end <= len(data) and len(lacing) == n:
                ok = page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == crc
        if not ok:
            bad += 1
            at = data.find(b"OggS", at + 1)
            continue
        pages += 1
        s = streams.setdefault(serial, Stream())
        if number != s.page or not flags & 1:
            if s.open is not None:  # the page that should go on with this packet is lost
                s.cut += 1
                s.open = None
        s.lost += max(0, number - s.page)
        s.page = number + 1
        skip = bool(flags & 1) and s.open is None
        s.cut += skip
        where, part = at + 27 + n, s.open if s.open is not None else bytearray()
        s.open = None
        begun = len(s.packets)
        for size in lacing:
            part += data[where : where + size]
            where += size
            if size < 255:
                if skip:
                    skip = False
                else:
                    s.packets.append(bytes(part))
                    s.times.append(float("nan"))
                part = bytearray()
        if n and lacing[-1] == 255 and not skip:
            s.open = part
        if granule >= 0 and len(s.packets) > begun:
            s.times[-1] = granule / RATE
        s.ended |= bool(flags & 4)
        at = end if data[end : end + 4] == b"OggS" else data.find(b"OggS", end)
        if at > end or (at < 0 and end < len(data)):
            bad += 1
    return Media(streams, pages, bad)


def describe(media: Media) -> str:
    """Pages, damaged spans, streams, packets, seconds, and the samples' mean, deviation and zero crossings."""
    x = np.frombuffer(media.samples(), dtype=np.uint8)
    last = max((v for s in media.streams.values() for v in s.times if v == v), default=0.0)
    packets = sum(len(s.packets) for s in media.streams.values())
    total, squares = int(x.sum(dtype=np.int64)), int(np.einsum("i,i->", x, x, dtype=np.int64)) if len(x) else 0
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    mean = total / max(len(x), 1)
    return f"pages={media.pages};bad={media.bad};streams={len(media.streams)};packets={packets};seconds={last:.6f};mean={mean:.6f};power={squares / max(len(x), 1):.6f};crossings={crossings}"


def padded(text: bytes) -> bytes:
    """text with bytes 0 up to the next multiple of 64 that is positive: none where its length is one."""
    return text + bytes(-len(text) % 64 or 64 * (not text))


def encode_column(df: DataFrame, text: str = "text", media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """df with a binary column of Ogg bytes made of the text's UTF-8 bytes, padded to 64."""

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([encode(padded((v.as_py() or "").encode())) for v in part.column(text)], pa.binary())]

    return extend(df, text, [t.StructField(media, t.BinaryType())], make, keep)


_READ = [("payload_bytes", t.LongType()), ("payload_sha256", t.StringType()), ("tail_crc32", t.LongType()), ("media_bytes", t.LongType()), ("media_sha256", t.StringType()), ("feature", t.StringType())]


def decode_column(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """df with what the stored bytes give: payload size and digests, and the features."""

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        out: list[list] = [[] for _ in _READ]
        for v in part.column(media):
            data = v.as_py() or b""
            m = decode(data)
            x = m.samples()
            for column, value in zip(out, (len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(data), hashlib.sha256(data).hexdigest(), describe(m)), strict=True):
                column.append(value)
        return [pa.array(c, pa.string() if f == t.StringType() else pa.int64()) for c, (_, f) in zip(out, _READ, strict=True)]

    return extend(df, media, [t.StructField(n, f) for n, f in _READ], make, keep)


def media_table(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    stored = encode_column(sized, keep=["doc_id", "n_bytes"])
    return decode_column(stored, keep=["doc_id", "n_bytes"])
