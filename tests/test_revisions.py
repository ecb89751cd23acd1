"""Revision log: decoding, key states, prefixes, gates."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from kvspace.functions import keys
from kvspace.operators import revisions as R
from kvspace.schemas import KV
from tests.conftest import rows

LOG = "key_hash string, key_text string, main_revision bigint, value_bytes bigint, stored_bytes bigint, tombstone boolean"


def log(spark, data):
    df = spark.createDataFrame(data, LOG)
    zero = F.lit(0).cast("bigint")
    return df.select(F.lit("t").alias("task_id"), "*", F.char_length("key_text").cast("bigint").alias("key_bytes"), zero.alias("sub_revision"), F.col("main_revision").alias("create_revision"), F.col("main_revision").alias("mod_revision"), zero.alias("version"), zero.alias("lease_id"), F.sha2("key_text", 256).alias("value_hash"))


@pytest.fixture(scope="module")
def small(spark):
    return log(spark, [("x", "/a/x", 1, 5, 10, False), ("x", "/a/x", 2, 8, 20, False), ("y", "/a/y", 3, 12, 30, False), ("y", "/a/y", 4, 0, 5, True)])


def raw_key(main, sub, tail=b""):
    return struct.pack(">Q", main) + b"_" + struct.pack(">Q", sub) + tail


def test_revision_keys(spark):
    bad = [b"", bytes(17), raw_key(1, 0, b"x"), raw_key(0, 1), raw_key(1 << 63, 0), raw_key(1, 1 << 63), raw_key(1, 0)[:16], raw_key(1, 0, b"tt"), raw_key(1, 0).replace(b"_", b"-")]
    good = [raw_key(12, 3), raw_key(12, 3, b"t")]
    kv = lambda key, value: (key, value, 1, 2, 3, 4)
    data = [(k, kv(b"/a", b"v"), 10) for k in bad] + [(good[0], kv(b"\xff\x01", b"value"), 20), (good[1], kv("/é".encode(), None), 7)]
    raw = spark.createDataFrame(data, KV)
    assert R.decode_errors(raw).first()[0] == len(bad)
    found = {r.tombstone: r for r in R.decode_revisions(raw, "t").collect()}
    assert (found[False].main_revision, found[False].sub_revision, found[False].key_text, found[False].stored_bytes, found[False].value_bytes) == (12, 3, "hex:ff01", 37, 5)
    assert (found[True].key_text, found[True].stored_bytes, found[True].key_bytes) == ("/é", 25, 3)
    assert R.decode_errors(raw.limit(0)).first()[0] == 0


def test_current_history_tombstones(small):
    found = {r.key_hash: r for r in R.key_records(small).collect()}
    x, y = found["x"], found["y"]
    assert (x.present, x.current_stored_bytes, x.historical_bytes, x.tombstone_bytes, x.prefix) == (True, 20, 10, 0, "/a")
    assert (y.present, y.current_stored_bytes, y.historical_bytes, y.tombstone_count, y.tombstone_bytes) == (False, 0, 30, 1, 5)
    assert x.historical_amplification == 0.5 and y.historical_amplification == 30
    top = R.top_prefixes(R.prefix_stats(R.key_records(small)), 1).first()
    assert (top.prefix, top.depth, top.current_key_count, top.current_bytes, top.historical_bytes, top.max_value_bytes) == ("/a", 1, 1, 8, 40, 8)
    s = R.mvcc_summary(R.key_records(small)).first()
    assert (s.revision_count, s.current_key_count, s.historical_versions, s.tombstone_count, s.key_count) == (4, 1, 2, 1, 2)


def test_latest_breaks_ties(spark, small):
    assert {(r.key_hash, r.main_revision) for r in R.latest_revision(small).collect()} == {("x", 2), ("y", 4)}
    assert R.latest_revision(small.unionByName(small)).count() == 2


def test_bytes_add_up(spark):
    import random

    rng = random.Random(9)
    data = [(f"k{i % 17}", f"/r/{i % 5}/k{i % 17}", i, rng.randrange(100), rng.randrange(1000), rng.random() < 0.2) for i in range(500)]
    own = log(spark, data)
    records = R.key_records(own)
    s = R.mvcc_summary(records).first()
    assert s.current_stored_bytes + s.historical_bytes + s.tombstone_bytes == sum(d[4] for d in data)
    top = R.prefix_stats(records).filter("depth = 1").agg(F.sum("historical_bytes"), F.sum("tombstone_count")).first()
    assert tuple(top) == (s.historical_bytes, s.tombstone_count)
    parts = R.prefix_parts(records)
    halves = R.prefix_merge(parts.filter("current_bytes % 2 = 0")).unionByName(R.prefix_merge(parts.filter("current_bytes % 2 = 1")))
    assert rows(R.prefix_merge(halves)) == rows(R.prefix_stats(records))


def test_ancestors(spark):
    cases = {"/a/b/c": ["/a", "/a/b", "/a/b/c"], "/": ["/"], "plain": ["plain"], "/a//b": ["/a", "/a/", "/a//b"], "/x/": ["/x"], "": [""]}
    df = spark.createDataFrame([(k,) for k in cases], "k string").select("k", keys.key_ancestors(F.col("k")).alias("a"), keys.primary_prefix(F.col("k")).alias("p"))
    for r in df.collect():
        assert r.a == cases[r.k]
        assert r.p == (cases[r.k][-2] if len(cases[r.k]) > 1 else r.k)


def test_filters_and_pages(small):
    records = R.key_records(small)
    assert [r.key_hash for r in R.query_keys(records).collect()] == ["y", "x"]
    assert [r.key_hash for r in R.query_keys(records, "key", False, 2, 1).collect()] == ["y"]
    assert [r.key_hash for r in R.query_keys(records, tombstones_only=True).collect()] == ["y"]
    assert R.query_keys_total(records, prefix="/a/x").first()[0] == 1 and R.query_keys_total(records, min_total_bytes=31).first()[0] == 1
    assert R.query_keys_total(records, min_revisions=3, prefix="/a%").first()[0] == 0
    assert [r.main_revision for r in R.key_revisions(small, "x").collect()] == [2, 1] and R.get_key(records, "x").count() == 1
    for bad in ({"sort": "nope"}, {"number": 0}, {"size": 501}, {"size": 0}):
        with pytest.raises(ValueError):
            R.query_keys(records, **bad)


def test_version_gates(spark):
    data = [("3.4.13", "manual", "3.4", True), ("v3.4.0", "manual", "3.4", True), ("3.4", "manual", "", False), ("3.4", "database_metadata", "", True), ("3.4.13", "database_metadata", "3.4", False), ("3.5.1", "manual", "", False), ("3.4.x", "manual", "", False), ("3.4.1.2", "manual", "", False), (None, "manual", "", False)]
    df = spark.createDataFrame([(str(i), v, s) for i, (v, s, _, _) in enumerate(data)], "task_id string, version string, source string")
    got = {int(r.task_id): r for r in df.select("task_id", keys.version_family(F.col("version")).alias("f"), F.coalesce(keys.semantic_gate(F.col("version"), F.col("source")), F.lit(False)).alias("g")).collect()}
    assert [(got[i].f, got[i].g) for i in range(len(data))] == [(f, g) for _, _, f, g in data]
    summary, finding = R.semantic_unavailable(df)
    assert summary.count() == finding.count() == sum(not g for *_, g in data)
    pairs = [("3.4.13", "3.4.15", True), ("3.4.13", "3.5.1", False), ("3", "3", False), ("3.4", "3.4.1", True), (None, "3.4", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    assert [r.c for r in df.select("i", keys.compatible_versions(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()] == [c for *_, c in pairs]
