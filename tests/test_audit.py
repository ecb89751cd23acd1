"""Requests: normalizing, stages, match levels, the stream."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kvspace.functions import keys, requests
from kvspace.operators import audit as A
from kvspace.operators import evidence as E


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line(**more):
    base = {"auditID": "a1", "stage": "ResponseComplete", "stageTimestamp": "2026-08-03T10:00:00.5Z", "verb": "Update", "user": {"username": "alice"}, "userAgent": "backup-agent/0.9.1 (arm64; nightly) hush-marker", "sourceIPs": ["172.18.9.200", "192.0.2.7"], "objectRef": {"apiVersion": "v1", "resource": "configmaps", "namespace": "ns", "name": "cm"}, "responseStatus": {"code": 200}, "requestObject": {"data": "own-value-31"}}
    return json.dumps(base | more, separators=(",", ":"))


def events(spark, *lines):
    rows = A.audit_rows(spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], "line_number bigint, line string"), "t")
    return rows, A.audit_events(rows)


def test_normalize(spark):
    r = events(spark, line())[1].first()
    assert (r.verb, r.user_agent, r.source_network, r.response_code, r.username, r.stage_rank) == ("update", "backup-agent/0.9.1", "172.18.9.0/24", 200, "alice", 4)
    assert r.observed_at == datetime(2026, 8, 3, 10, 0, 0, 500000) and r.source_ip_hash == sha("172.18.9.200") and r.object_key_hash == sha("/registry/configmaps/ns/cm")
    assert r.request_object_bytes == len('{"data":"own-value-31"}') and r.response_object_bytes == 0
    assert not any("own-value-31" in str(v) or "hush-marker" in str(v) or "172.18.9.200" in str(v) for v in r)


def test_defaults_and_bad_lines(spark):
    bare = json.dumps({"verb": "GET", "requestReceivedTimestamp": "2026-08-03T09:00:00Z", "objectRef": {"apiVersion": "apps/v1", "resource": "deployments"}})
    rows, own = events(spark, "{bad json}", bare, bare + " ", "", "[]", line(auditID=""))
    found = {r.line_number: r for r in own.collect()}
    assert set(found) == {2, 3, 6}
    assert (found[2].username, found[2].username_hash, found[2].api_group, found[2].object_key_hash, found[2].source_network) == ("unknown", sha(""), "apps", "", "")
    assert found[2].observed_at == datetime(2026, 8, 3, 9) and found[2].audit_id_hash == found[3].audit_id_hash == sha(bare) != sha("")
    s = A.audit_scan_summary(rows).first()
    assert (s.total_lines, s.valid_events, s.write_events, s.parse_errors, s.duplicate_events) == (6, 3, 1, 3, 1)


def test_stages(spark):
    cases = [line(stage="RequestReceived", responseStatus={"code": 0}), line(responseStatus={"code": 204}), line(responseStatus={"code": 500}), line(stage="RequestReceived"), line(auditID="b", stage="odd")]
    own = A.audit_dedup(events(spark, *cases)[1])
    assert {(r.audit_id_hash, r.response_code, r.line_number) for r in own.collect()} == {(sha("a1"), 204, 2), (sha("b"), 200, 5)}


def test_window_without_all_events_normalized(spark):
    """The same as normalizing everything first: a read that comes last, or a write outside, decides over its id."""
    cases = [line(), line(stage="RequestReceived", verb="get"), line(auditID="b", verb="get"), line(auditID="b", stage="RequestReceived"), line(auditID="c", stageTimestamp="2026-08-03T12:00:00Z"), line(auditID="c", stage="Panic"), line(auditID="", verb="patch"), "{bad", "[]", line(auditID="d", verb="PATCH", sourceIPs=None)]
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(cases, 1)], "line_number bigint, line string")
    wanted = lambda e: E.audit_writes(e, datetime(2026, 8, 3, 9), datetime(2026, 8, 3, 11))
    whole = wanted(A.audit_dedup(events(spark, *cases)[1]))
    found = A.audit_window(lines, "t", wanted)
    assert found.schema == whole.schema and sorted(found.collect()) == sorted(whole.collect()) and {r.line_number for r in found.collect()} == {1, 7, 10}


def test_networks(spark):
    cases = {"172.18.9.200": "172.18.9.0/24", "2001:db8:aa:7::9": "2001:db8:aa:7::/64", "::1": "::/64", "no ip": "unknown", "300.1.1.1": "unknown", "01.2.3.4": "unknown", "a:b": "unknown"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "ip string").select("ip", requests.mask_network(F.col("ip")).alias("m"))
    assert {r.ip: r.m.network for r in df.collect()} == cases | {None: ""}


def test_network_of_any_address(spark):
    """Addresses in all spellings, and broken ones, against the standard library."""
    import ipaddress
    import random

    rng = random.Random(3)
    made = ["::", "::1", "1::", "fe80::1%eth0", "fe80::1%", "a%b%c", "::ffff:1.2.3.4", "1.2.3.4::", "::1.2.3", "::01.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1::2::3", ":1::", "1:2:3:4:5:6:7", "12345::", "g::", "1:2:3:4:5:6:1.2.3.4", "0:0:1:2:0:0:0:0", "2001:DB8:0:0::", "%::", "::%x"]
    for _ in range(400):
        groups = [rng.choice(["0", "0", "00", "1", "A0", "0db8", "ffff"]) for _ in range(8)]
        a, b = sorted(rng.sample(range(9), 2))
        text = ":".join(groups) if rng.random() < 0.3 else ":".join(groups[:a]) + "::" + ":".join(groups[b:])
        made.append(text[: rng.choice([len(text)] * 4 + [len(text) - 1])] + rng.choice([""] * 6 + [":", ":1", "."]))

    def want(ip):
        try:
            found = ipaddress.ip_address(ip)
        except ValueError:
            return "unknown"
        return str(ipaddress.IPv6Network((int(found) >> 64 << 64, 64)))

    cases = [m for m in set(made) if ":" in m]
    df = spark.createDataFrame([(c,) for c in cases], "ip string").select("ip", requests.mask_network(F.col("ip"))["network"].alias("n"))
    assert {r.ip: r.n for r in df.collect()} == {c: want(c) for c in cases}


def test_object_keys(spark):
    cases = [(("", "secrets", "default", "db-password"), "/registry/secrets/default/db-password"), (("", "services", "d", "a"), "/registry/services/specs/d/a"), (("", "endpoints", "d", "a"), "/registry/services/endpoints/d/a"), (("apps", "deployments", "d", "a"), "/registry/deployments/d/a"), (("x.io", "ws", "", "a"), "/registry/x.io/ws/a"), (("rbac", "roles", "d", "a"), "/registry/rbac/roles/d/a"), (("", "pods", "d", ""), None)]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, g string, r string, n string, o string")
    found = df.select("i", keys.object_key_hash(*[F.col(c) for c in "grno"]).alias("k")).orderBy("i").collect()
    assert [r.k.hash for r in found] == [sha(t) if t else "" for _, t in cases]
    assert found[0].k.display_name == "redacted:" + sha(cases[0][1])[:12] and found[1].k.display_name == "a"


def test_verbs(spark):
    df = spark.createDataFrame([("Patch",), ("get",), ("proxy",), ("odd",)], "v string")
    assert [tuple(r) for r in df.select(requests.is_write_verb(F.col("v")), requests.is_verb(F.col("v"))).collect()] == [(True, True), (False, True), (False, True), (False, False)]


def test_match_levels(spark):
    who = [("alice", "apps", "deployments", "prod", "hot"), ("bob", "batch", "jobs", "jobs", "u1"), ("carol", "batch", "jobs", "other", "u2"), ("dave", "", "pods", "none", "none"), ("erin", "legacy.example.io", "widgets", "old", "shrunk")]
    at = datetime(2026, 8, 3, 10, 1)
    own = spark.createDataFrame([(i, u, sha(u), "a", "h", "n", "i", g, r, n, o, "update", 5, 7, at) for i, (u, g, r, n, o) in enumerate(who)], "line_number bigint, username string, username_hash string, user_agent string, user_agent_hash string, source_network string, source_ip_hash string, api_group string, resource string, namespace string, object_key_hash string, verb string, request_object_bytes bigint, response_object_bytes bigint, observed_at timestamp")
    objects = spark.createDataFrame([("hot", "apps", "deployments", "prod", 10, 0), ("shrunk", "legacy.example.io", "widgets", "old", -5, 0)], "key_hash string, api_group string, resource string, namespace string, total_bytes_delta bigint, revision_count_delta bigint")
    resources = spark.createDataFrame([("apps", "deployments", 5, 0), ("batch", "jobs", 0, 1), ("", "pods", -1, 0)], "api_group string, resource string, total_bytes_delta bigint, current_objects_delta bigint")
    spaces = spark.createDataFrame([("prod", 1, 0), ("jobs", 1, 0), ("", 1, 0)], "namespace string, total_bytes_delta bigint, current_objects_delta bigint")
    summary = spark.createDataFrame([(at, at)], "first_observed_at timestamp, last_observed_at timestamp")
    for most in (E.BROADCAST_ROWS, 0):
        sets = E.growth_sets(objects, resources, spaces)
        matched = E.match_growth_sets(own, sets, most).withColumn("l", E.audit_match_level())
        assert {r.username: r.l for r in matched.collect()} == {"alice": "high", "bob": "medium", "carol": "low", "dave": "unverified", "erin": "unverified"}
    out = E.audit_evidence(own, summary, sets, datetime(2026, 8, 3, 10), datetime(2026, 8, 3, 11))
    found = out["candidates"].collect()
    assert [r.username for r in found] == ["alice", "bob", "carol"] and out["items"].count() == 5
    assert (found[0].exact_object_matches, found[1].resource_matches, found[1].namespace_matches, found[2].resource_matches, found[2].namespace_matches) == (1, 1, 1, 1, 0)
    assert tuple(out["head"].first()) == (5, "partial")


@pytest.mark.parametrize(("first", "last", "expected"), [(None, None, "unknown"), (10, 12, "full"), (11, 12, "partial"), (13, 14, "none"), (8, 10, "none"), (9, 13, "full"), (12, 12, "partial")])
def test_coverage(spark, first, last, expected):
    hour = lambda h: None if h is None else datetime(2026, 8, 3, h)
    df = spark.createDataFrame([(hour(first), hour(last))], "a timestamp, b timestamp")
    assert df.select(E.evidence_coverage(F.col("a"), F.col("b"), hour(10), hour(12))).first()[0] == expected


def test_window_and_counts(spark):
    lines = [line(auditID=str(i), stageTimestamp=f"2026-08-03T10:0{i}:00Z", verb="get" if i == 4 else "update", user={"username": "alice" if i in (1, 3) else "bob"}) for i in range(5)]
    own = events(spark, *lines)[1]
    inside = own.filter(F.col("verb").isin(*requests.WRITE_VERBS) & (F.col("observed_at") > F.lit(datetime(2026, 8, 3, 10))) & (F.col("observed_at") <= F.lit(datetime(2026, 8, 3, 10, 3))))
    assert {(r.dimension, r.value): r["count"] for r in A.audit_counts(inside).collect()}["username", "alice"] == 2
    assert [r.line_number for r in A.audit_timeline(own, datetime(2026, 8, 3, 10, 2), None, verb="update").collect()] == [4, 3]
