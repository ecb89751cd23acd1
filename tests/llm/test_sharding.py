"""Jump hashing against its definition; gapless slots."""

from __future__ import annotations

import zlib

import numpy as np

from kvspace.llm import sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.arange(-100, 4000, dtype=np.int64)
    for n in (1, 2, 40, 41, 1000):
        assert sharding.jump_hash(keys.view(np.uint64), n).tolist() == [jump(int(k) % (1 << 64), n) for k in keys]
    before, after = sharding.jump_hash(keys.view(np.uint64), 40), sharding.jump_hash(keys.view(np.uint64), 41)
    moved = before != after
    assert (after[moved] == 40).all() and 0.01 < moved.mean() < 0.05


def test_manifest(spark):
    rows = [(i, f"té {i}") for i in range(3000)] + [(None, None), (5, "té 5"), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS shard", "1 AS slot")
    found = sharding.manifest(docs).collect()
    assert len(found) == len(rows)
    number = lambda i: -1 if i is None else i
    assert sorted((number(r.doc_id), r.size, r.text_crc32) for r in found) == sorted((number(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in found:
        assert r.shard == jump((r.doc_id or 0) % (1 << 64), 40) and r.grown_shard == jump((r.doc_id or 0) % (1 << 64), 41) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.manifest(docs.limit(0)).count() == 0


def test_text_keys(spark):
    named = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    found = sharding.assign(named, "k", 7).collect()
    assert len({r.shard for r in found if r.k == "a"}) == 1 and all(0 <= r.shard < 7 for r in found)
