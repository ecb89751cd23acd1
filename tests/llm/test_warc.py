"""Round trips and salvage of archives."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from kvspace.llm import warc


def archive(compress, n=30):
    rng = random.Random(2)
    payloads = [rng.randbytes(rng.randrange(2500)) for _ in range(n)]
    return payloads, [warc.record("response", f"urn:page:{i}", f"http://x/{i}", p, compress=compress) for i, p in enumerate(payloads)]


@pytest.mark.parametrize("compress", [True, False])
def test_whole_archive(compress):
    payloads, records = archive(compress)
    found = list(warc.salvage(b"".join(records)))
    assert [f.payload for f in found] == payloads and {f.kind for f in found} == {"record"}


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("seed", range(8))
def test_damaged_archive(compress, seed):
    payloads, records = archive(compress)
    rng = random.Random(seed)
    data, hit, at = bytearray(), set(), 0
    for i, r in enumerate(records):
        r = bytearray(r)
        if rng.random() < 0.2:
            hit.add(i)
            where = rng.randrange(len(r) // 2, len(r) - 4)
            r = r[:where] if rng.random() < 0.3 else r[:where] + bytes([r[where] ^ 0x55]) + r[where + 1 :]
        data += r
    data = bytes(data) + b"junk at the end"
    found = list(warc.salvage(data))
    got = {f.headers["warc-record-id"] for f in found if f.headers}
    assert got >= {f"<urn:page:{i}>" for i in range(30) if i not in hit}
    at = 0
    for f in found:  # spans cover every byte
        assert f.offset == at
        at += f.length
    assert at == len(data) and found[-1].kind == "gap"


def test_empty_and_junk():
    assert list(warc.salvage(b"")) == []
    assert [(f.kind, f.length) for f in warc.salvage(b"no archive" * 9)] == [("gap", 90)]
    one = warc.record("response", "a", "u", b"x", compress=False)
    both = gzip.compress(one + one)
    assert len(list(warc.salvage(both))) == 2


def ids(found):
    return [int(f.headers["warc-record-id"].split(":")[2][:-1]) for f in found if f.headers]


def test_damaged_record_in_a_member():
    payloads, records = archive(False)
    bad = bytearray(records[7])
    bad[-10] ^= 0x55
    one, all_ = gzip.compress(records[0]), gzip.compress(b"".join([*records[1:7], bytes(bad), *records[8:]]))
    found = list(warc.salvage(one + all_))
    assert ids(found) == [i for i in range(30) if i != 7]
    assert [f.payload for f in found if f.headers] == [p for i, p in enumerate(payloads) if i != 7]
    assert [(f.offset, f.length, f.reason) for f in found if f.kind == "gap"] == [(len(one), len(all_), "block digest does not match")]


def test_damaged_stream_of_records():
    payloads, records = archive(False)
    whole, last = gzip.compress(b"".join(records)), gzip.compress(warc.record("response", "urn:page:99", "u", b"x", compress=False))
    crc = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    found = list(warc.salvage(crc + last))
    assert ids(found) == [*range(30), 99] and all(f.reason for f in found[:-1]) and not found[-1].reason
    for cut in (len(whole) // 2, len(whole) - 9, len(whole) - 6, len(whole) - 2):
        for tail in (b"", last):
            found = list(warc.salvage(whole[:cut] + tail))
            got = ids(found)
            assert got[: len(got) - bool(tail)] == list(range(len(got) - bool(tail))) and len(got) > 10
            assert not tail or got[-1] == 99
            assert [f.payload for f in found if f.headers and f.reason] == payloads[: len(got) - bool(tail)]
            assert any(f.kind == "gap" for f in found) or len(got) >= 30
    bare = re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", b"".join(records))
    bad = gzip.compress(bare)
    found = list(warc.salvage(bad[:-8] + bytes(8)))
    assert ids(found) == list(range(30)) and {f.kind for f in found if f.headers} == {"unverified"}


@pytest.mark.parametrize("seed", range(30))
def test_spans_of_a_damaged_stream(seed):
    payloads, records = archive(False)
    rng = random.Random(seed)
    whole = bytearray(gzip.compress(b"".join(records)))
    whole[rng.randrange(len(whole))] ^= 1 << rng.randrange(8)
    last = warc.record("response", "urn:page:99", "u", b"x")
    found, end = list(warc.salvage(bytes(whole) + last)), 0
    for f in found:
        assert f.offset <= end
        end = max(end, f.offset + f.length)
    assert end == len(whole) + len(last) and ids(found)[-1] == 99
    assert all(f.payload in payloads for f in found[:-1] if f.kind == "record")


def test_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a/x", big), (5, "http://a/y", big), (3, None, big), (7, "u", None), (8, "u\r\nx", "a"), (9, "u", "a"), (10, "v", "z" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS digest", "2 AS first")
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    expected = [(i, len((t or "").encode()), digest(t), "revisit" if i in (1, 3) else "response", 5 if i in (1, 3) else None) for i, _, t in rows]
    assert sorted(map(tuple, warc.round_trip(pages).collect())) == sorted(expected)
    assert warc.round_trip(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", big), (1, "u", big)], "page_id long, url string, html string")
    assert [r.record_type for r in warc.round_trip(twice).collect()] == ["response", "response"]


def test_read_files(spark, tmp_path):
    payloads, records = archive(True)
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    (tmp_path / "b.warc").write_bytes(b"".join(archive(False)[1])[7:])
    rows = warc.read_files(spark, str(tmp_path)).collect()
    assert sum(r.kind == "record" for r in rows) == 59
    gap = [(r.archive.rsplit("/", 1)[1], r.offset, r.length, r.reason) for r in warc.gap_log(warc.read_files(spark, str(tmp_path))).collect()]
    assert gap == [("b.warc", 0, len(archive(False)[1][0]) - 7, "no version line")]


def test_damaged_archives_of_pages(spark):
    """Every archive is damaged in its middle: the records around it are all there, what is lost is told."""
    rng = random.Random(5)
    pages = spark.createDataFrame([(i, f"http://h/{i}", rng.randbytes(400).hex()) for i in range(300)], "page_id long, url string, html string")
    archives = warc.write_archives(pages.repartition(3))
    middle = F.expr("length(content) div 2")
    broken = archives.select("archive", F.overlay(F.col("content"), F.lit(b"\x00\xff\x00\xff"), middle.cast("int"), F.lit(4)).alias("content"))
    found = warc.read_archives(broken)
    n, gaps = found.filter("kind <> 'gap'").select("record_id").distinct().count(), warc.gap_log(found).collect()
    assert n >= 300 - 2 * archives.count() and n + 2 * len(gaps) >= 300 and gaps and all(g.length > 0 and g.reason for g in gaps)


def test_time_follows_length():
    _, records = archive(True, 400)
    took = []
    for times in (20, 80):
        data = b"".join(records) * times
        begun = time.perf_counter()
        assert sum(f.kind == "record" for f in warc.salvage(data)) == 400 * times
        took.append(time.perf_counter() - begun)
    assert took[1] < 8 * took[0]


def test_many_broken_headers():
    """A megabyte of version lines whose headers never end is searched once, and a record behind it is found."""
    good = warc.record("response", "urn:x", "http://a/", b"payload", compress=False)
    broken = b"WARC/1.1\r\nX: y\r\n" * 65_536
    began = time.thread_time()
    found = list(warc.salvage(broken + good))
    assert time.thread_time() - began < 5
    assert [f.kind for f in found] == ["gap", "record"] and found[0].length == len(broken) and found[1].payload == b"payload"
