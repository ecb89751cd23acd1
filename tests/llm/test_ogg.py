"""Ogg columns: checksum, round trips, damage, several streams."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from kvspace.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 7, 300):
        data = rng.randbytes(n)
        assert ogg.page_crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 254, 255, 256, 4096, 65_024, 65_025, 65_026, 300_000])
def test_round_trip(n):
    payload = ogg.padded(random.Random(n).randbytes(n))
    media = ogg.decode(ogg.encode(payload))
    assert media.samples() == payload and media.bad == 0 and len(media.streams) == 2
    assert all(s.ended and not s.cut for s in media.streams.values())
    last = max(t for s in media.streams.values() for t in s.times if t == t)
    assert last == len(payload) / ogg.RATE
    assert len(payload) % 64 == 0 and n <= len(payload) < n + 64 or n == 0 and len(payload) == 64


def test_padding():
    sizes = {0: 64, 1: 64, 63: 64, 64: 64, 65: 128, 128: 128, 129: 192}
    for n, size in sizes.items():
        assert ogg.padded(b"x" * n) == b"x" * n + b"\0" * (size - n)


def test_packets_over_page_borders():
    packets = [(b"h", 0), (b"a" * 70_000, 1), (b"", 2), (b"b" * 255, 3), (b"c" * 200_000, 4)]
    data = b"".join(ogg.write_stream(9, packets))
    assert ogg.decode(data).streams[9].packets == [p for p, _ in packets]


def test_damage_is_skipped():
    data = bytearray(ogg.encode(ogg.padded(bytes(300_000))))
    data[150_000] ^= 1
    media = ogg.decode(bytes(data))
    assert media.bad == 1 and sum(s.lost for s in media.streams.values()) == 1
    assert 200_000 < len(media.samples()) < 300_000
    assert ogg.decode(b"").pages == ogg.decode(b"no pages here").pages == 0


def test_table(spark):
    texts = [(1, "abc"), (2, None), (3, ""), (4, "é" * 50_000), (5, "abc"), (5, "abc"), (6, "x" * 64)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'c' AS media", "1 AS n_bytes")
    found = {r.doc_id: r for r in ogg.media_table(docs).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\0" * ({0: 64, 3: 61, 64: 0, 100_000: 32}[len(raw)])
        r = found[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(ogg.encode(payload)).hexdigest() and r.media_bytes == len(ogg.encode(payload))
    assert found[1].feature == found[5].feature and found[2].media_sha256 == found[3].media_sha256
    assert ogg.media_table(docs).count() == 7 and ogg.media_table(docs.limit(0)).count() == 0


def pages_of(data):
    """(serial, flags, granule, lacing, body) of each page, straight from the format's description."""
    at = 0
    while at < len(data):
        assert data[at : at + 5] == b"OggS\0"
        n = data[at + 26]
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        assert slow_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == int.from_bytes(data[at + 22 : at + 26], "little")
        yield int.from_bytes(data[at + 14 : at + 18], "little"), data[at + 5], int.from_bytes(data[at + 6 : at + 14], "little", signed=True), lacing, data[at + 27 + n : end]
        at = end


@pytest.mark.parametrize("n", [0, 5, 64, 5000, 20_000])
def test_stored_form_and_features(n):
    text = random.Random(n).randbytes(n)
    payload = text + bytes((-n) % 64) if n else bytes(64)
    data, streams, granules = ogg.encode(payload), {}, {}
    for serial, _, granule, lacing, body in pages_of(data):
        packets = streams.setdefault(serial, [b""])
        granules.setdefault(serial, []).append(granule)
        for size in lacing:
            packets[-1], body = packets[-1] + body[:size], body[size:]
            if size < 255:
                packets.append(b"")
    assert len(streams) == 2
    sound = next(p for p in streams.values() if p[0].startswith(b"PCM8"))
    assert b"".join(sound[1:]) == payload and max(g for own in granules.values() for g in own) == len(payload)
    high = [x >= 128 for x in payload]
    feature = dict(x.split("=") for x in ogg.describe(ogg.decode(data)).split(";"))
    assert int(feature["pages"]) == len(list(pages_of(data))) and feature["bad"] == "0" and int(feature["packets"]) == sum(len(p) - 1 for p in streams.values())
    assert feature["seconds"] == f"{len(payload) / 8000:.6f}" and feature["mean"] == f"{sum(payload) / len(payload):.6f}" and feature["power"] == f"{sum(x * x for x in payload) / len(payload):.6f}"
    assert int(feature["crossings"]) == sum(a != b for a, b in zip(high, high[1:], strict=False))
