"""Snapshot differences."""

from __future__ import annotations

from datetime import datetime

import pytest

from kvspace.operators import diff as D
from kvspace.operators import physical as P

KEYS = "key_hash string, key_text string, prefix string, present boolean, current_stored_bytes bigint, historical_bytes bigint, tombstone_bytes bigint, revision_count bigint"


def side(spark, **own):
    return spark.createDataFrame([(k, f"/{k}", "/", *v) for k, v in own.items()], KEYS)


def test_alignment(spark):
    base = side(spark, a=(True, 100, 0, 0, 1), gone=(True, 40, 0, 0, 1), same=(True, 7, 1, 0, 2), dead=(True, 100, 0, 0, 1), moved=(True, 100, 0, 0, 1), back=(False, 0, 5, 1, 1))
    target = side(spark, a=(True, 160, 0, 0, 2), new=(True, 25, 0, 0, 1), same=(True, 7, 1, 0, 2), dead=(False, 0, 0, 0, 1), moved=(True, 0, 100, 0, 1), back=(True, 9, 5, 1, 2), ghost=(False, 0, 3, 1, 2))
    found = {r.key_hash: (r.change_type, r.total_bytes_delta) for r in D.diff_keys(base, target).collect()}
    assert found == {"a": ("modified", 60), "gone": ("deleted", -40), "new": ("added", 25), "dead": ("deleted", -100), "moved": ("modified", 0), "back": ("added", 9), "ghost": ("deleted", 4)}
    reverse = {r.key_hash: r.total_bytes_delta for r in D.diff_keys(target, base).collect()}
    assert reverse == {k: -v for k, (_, v) in found.items()}
    assert [r.key_hash for r in D.query_key_deltas(D.diff_keys(base, target), size=2).collect()] == ["a", "new"]
    assert D.query_key_deltas(D.diff_keys(base, target), "deleted", "/g").count() == 2
    churn = D.churn_per_hour(D.diff_keys(base, target), 1, 7200).first()
    assert churn.revision_count_delta == 2 and churn.revisions_per_hour == 1.0
    assert D.churn_per_hour(D.diff_keys(base, target), 1, None).first().revisions_per_hour is None
    assert D.diff_keys(base.limit(0), target.limit(0)).count() == 0


def test_objects(spark):
    schema = "key_hash string, api_group string, resource string, namespace string, display_name string, present boolean, current_bytes bigint, historical_bytes bigint, revision_count bigint"
    make = lambda *data: spark.createDataFrame([(h, "", "pods", "n", h, True, *v) for h, *v in data], schema)
    base, target = make(("modified", 100, 20, 2), ("deleted", 40, 10, 2), ("unchanged", 10, 2, 1)), make(("modified", 130, 50, 5), ("added", 60, 0, 1), ("unchanged", 10, 2, 1))
    found = {r.key_hash: (r.change_type, r.current_bytes_delta, r.historical_bytes_delta, r.revision_count_delta) for r in D.diff_objects(base, target).collect()}
    assert found == {"modified": ("modified", 30, 30, 3), "deleted": ("deleted", -40, -10, -2), "added": ("added", 60, 0, 1)}
    assert [r.key_hash for r in D.query_object_deltas(D.diff_objects(base, target), sort="history", descending=False).collect()] == ["deleted", "added", "modified"]


def test_rollups(spark):
    schema = "api_group string, resource string, current_objects bigint, current_bytes bigint, historical_bytes bigint"
    a, b = spark.createDataFrame([("", "pods", 1, 100, 0)], schema), spark.createDataFrame([("", "pods", 1, 180, 0), ("x", "y", 1, 5, 5)], schema)
    assert [(r.resource, r.total_bytes_delta) for r in D.top_resource_deltas(D.diff_resources(a, b), 5).collect()] == [("pods", 80), ("y", 10)]
    with pytest.raises(ValueError):
        D.top_resource_deltas(D.diff_resources(a, b), 501)


def mvcc(spark, revisions, semantic=True):
    return spark.createDataFrame([(semantic, revisions, 1, 1, 1, 1, 1, 1)], "semantic_available boolean, " + ", ".join(f"{c} bigint" for c in D.MVCC))


def test_summaries(spark):
    r = D.diff_mvcc_summary(mvcc(spark, 3), mvcc(spark, 8), "3.4.13", "3.4.15", 10).first()
    assert (r.mvcc_available, r.revision_count_delta, r.average_revisions_per_second) == (True, 5, 0.5)
    assert D.diff_mvcc_summary(mvcc(spark, 3), mvcc(spark, 8), "3.4.13", "3.4.15", 0).first().average_revisions_per_second is None
    for a, b, v in ((mvcc(spark, 3, False), mvcc(spark, 8), "3.4.15"), (mvcc(spark, 3), mvcc(spark, 8), "3.5.1"), (mvcc(spark, 3).limit(0), mvcc(spark, 8), "3.4.15")):
        r = D.diff_mvcc_summary(a, b, "3.4.13", v, 10).first()
        assert (r.mvcc_available, r.revision_count_delta, r.average_revisions_per_second) == (False, 0, None)


def test_window():
    day = datetime(2024, 1, 1)
    assert D.validate_window(None, None) is None and D.validate_window(day, datetime(2024, 1, 1, 0, 0, 10)) == 10
    for a, b in ((day, None), (None, day), (day, day), (datetime(2024, 1, 2), day)):
        with pytest.raises(ValueError):
            D.validate_window(a, b)


def test_physical(spark):
    schema = "task_id string, page_id bigint, page_type string, overflow bigint, total_bytes bigint, used_bytes bigint, free_bytes bigint, utilization double"
    page = lambda i, kind, over: ("t", i, kind, over, 10 * (1 if kind == "free" else over + 1), 0 if kind == "free" else 10, 10 if kind == "free" else 0, 1.0)
    pages = spark.createDataFrame([page(0, "meta", 0), page(1, "meta", 0), page(2, "freelist", 1), page(4, "leaf", 2), page(7, "branch", 0), page(8, "free", 3), page(9, "odd", 1)], schema)
    s = P.space_summary(pages, 10).first()
    assert (s.page_count, s.meta_pages, s.freelist_pages, s.leaf_pages, s.branch_pages, s.overflow_pages, s.free_pages, s.unknown_pages) == (11, 2, 2, 1, 1, 2, 1, 2)
    assert (s.physical_file_size, s.free_page_bytes, s.in_use_page_bytes) == (110, 10, 100)
    assert P.space_summary(pages, 10, 5).first().free_page_bytes == 5 and P.space_summary(pages.limit(0), 10).first().fragmentation_ratio == 0
    assert [r.page_id for r in P.query_pages(pages, "meta").collect()] == [0, 1]
    r = D.diff_physical(P.space_summary(pages, 10, 1000), P.space_summary(pages, 10, 1600)).first()
    assert r.physical_available and r.physical_file_size_delta == 600
    assert D.diff_physical(P.space_summary(pages, 10).limit(0), P.space_summary(pages, 10)).first().physical_unavailable_reason == "baseline physical analysis unavailable"
    assert D.diff_physical(P.space_summary(pages, 10), P.space_summary(pages, 10).limit(0)).first().physical_unavailable_reason == "target physical analysis unavailable"
    buckets = spark.createDataFrame([("t", "a", 1, 1, 2, 3, 4, 5, 6), ("t", "a/b", 2, 10, 20, 30, 40, 50, 60)], "task_id string, bucket_path string, depth bigint, key_count bigint, branch_bytes bigint, leaf_bytes bigint, overflow_bytes bigint, total_bytes bigint, used_bytes bigint")
    assert {(r.bucket_path, r.depth, r.key_count, r.total_bytes) for r in P.bucket_rollup(buckets).collect()} == {("a", 1, 11, 55), ("a/b", 2, 10, 50)}
    assert P.top_buckets(buckets, 1).first().bucket_path == "a/b"
