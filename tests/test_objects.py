"""Registry identity, values, fields, object aggregates and field diffs."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from kvspace.functions import keys, values
from kvspace.operators import objects as O
from kvspace.operators import report

FIELD = "array<struct<path:string,byte_size:bigint,type_class:string,hash:string>>"

IDENTITIES = [
    ("/registry/pods/default/nginx", ("", "pods", "default", "nginx"), ()),
    ("/registry/deployments/prod/api", ("apps", "deployments", "prod", "api"), ()),
    ("/registry/leases/kube-node-lease/node-a", ("coordination.k8s.io", "leases", "kube-node-lease", "node-a"), ()),
    ("/registry/nodes/node-a", ("", "nodes", "", "node-a"), ("cluster_scoped",)),
    ("/registry/nodes/a/b", ("", "nodes", "", ""), ("cluster_scoped",)),
    ("/registry/example.io/widgets/default/demo", ("example.io", "widgets", "default", "demo"), ("crd",)),
    ("/registry/example.io/widgets/demo", ("example.io", "widgets", "", "demo"), ("crd", "cluster_scoped")),
    ("/registry/services/specs/default/api", ("", "services", "default", "api"), ()),
    ("/registry/services/endpoints/default/api", ("", "endpoints", "default", "api"), ()),
    ("/registry/pods/default", ("", "pods", "default", ""), ()),
    ("/registry/secrets/default/db-password", ("", "secrets", "default", "db-password"), ("sensitive",)),
    ("/registry/", ("", "", "", ""), ()),
]


def test_identity(spark):
    df = spark.createDataFrame([(k,) for k, *_ in IDENTITIES] + [("/not-registry/pods/default/nginx",)], "k string")
    found = {r.k: r.i for r in df.select("k", keys.registry_identity(F.col("k"), F.lit("0123456789abcdef")).alias("i")).collect()}
    assert found["/not-registry/pods/default/nginx"] is None
    for key, parts, flags in IDENTITIES:
        i = found[key]
        assert (i.api_group, i.resource, i.namespace, i.name) == parts, key
        assert {f for f in ("crd", "cluster_scoped", "sensitive") if i[f]} == set(flags), key
        assert i.display_name == ("redacted:0123456789ab" if "sensitive" in flags else i.name)
    redacted = report.redact_report_keys(df.select(F.col("k").alias("key_text"), F.lit("0123456789abcdef").alias("key_hash")))
    assert "/registry/secrets/default/redacted:0123456789ab" in {r.key_text for r in redacted.collect()}
    assert not any("db-password" in r.key_text for r in redacted.collect())


def fields_of(text):
    status, found = values.object_fields(text)
    return status, {f[0]: f[1:] for f in found}


def test_fields():
    status, found = fields_of(json.dumps({"metadata": {"name": "a<b", "labels": {"x": {"y": 1}}}, "spec": {"n": 1.0, "z": [1, {"q": 2}], "renewTime": None}, "e": 1e21}))
    assert status == "decoded_json"
    assert found["metadata.name"] == (len('"a\\u003cb"'), "string", hashlib.sha256(b'"a\\u003cb"').hexdigest())
    assert found["metadata.labels"][:2] == (len('{"x":{"y":1}}'), "object") and not any(p.startswith("metadata.labels.") for p in found)
    assert found["spec.n"][:2] == (1, "number") and found["spec.z"][:2] == (len('[1,{"q":2}]'), "array") and found["spec.renewTime"][:2] == (4, "null") and found["e"][0] == len("1e+21")
    assert "metadata" not in found and "spec.z.q" not in found


def test_field_limits():
    _, found = values.object_fields(json.dumps({"spec": {f"f{i:02d}": "x" * i for i in range(30)}}))
    assert len(found) == 21 and found[0][0] == "spec" and found[1][0] == "spec.f29"
    deep = "x"
    for _ in range(130):
        deep = {"a": deep}
    assert values.object_fields(json.dumps(deep))[0] == "field_limit_exceeded"
    assert values.object_fields(json.dumps({"a": list(range(60_000))}))[0] == "field_limit_exceeded"
    assert [values.object_fields(t)[0] for t in ("[]", "{bad", "", None, "NaN", "null")] == ["decode_failed"] * 6
    twice = values.object_fields('{"a.b": "longer text", "a": {"b": 1}}')[1]
    assert [f[1] for f in twice if f[0] == "a.b"] == [len('"longer text"')]


@pytest.mark.parametrize(("number", "text"), [(0.0, "0"), (1.0, "1"), (1.5, "1.5"), (100.0, "100"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.25e-7, "1.25e-07"), (1e-6, "0.000001"), (-2.5, "-2.5"), (123456789.125, "123456789.125"), (0.1, "0.1")])
def test_numbers(number, text):
    assert values.canonical(number).decode() == text


def test_statuses(spark):
    key = "/registry/pods/default/p"
    cases = [(key, b'{"a":1}', "decoded_json"), (key, b"[1]", "decode_failed"), (key, b"k8s:enc:aescbc:v1:key:x", "encrypted"), (key, b"k8s\x00abc", "protobuf_unsupported"), (key, b"k8s 00", "format_unknown"), (key, b"\xff", "format_unknown"), ("/registry/pods/default", b"{}", "path_unknown"), ("/other", b"{}", None)]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, k string, v binary")
    found = df.select("i", values.classify_value(F.col("v"), keys.registry_identity(F.col("k"), F.lit(""))).alias("c")).orderBy("i").collect()
    assert [r.c and r.c.decode_status for r in found] == [s for *_, s in cases]


def revision(key, main, size, status, fields=()):
    identity = {"pod": ("", "pods", "default", "p"), "ns1": ("", "namespaces", "", "alpha"), "ns2": ("", "namespaces", "", "beta"), "secret": ("", "secrets", "default", "s")}[key]
    return ("t", key, main, 0, "/registry", *identity, "redacted:x" if key == "secret" else identity[3], False, key.startswith("ns"), key == "secret", "json", status, size, [(p, b, "object", h) for p, b, h in fields])


SCHEMA = f"task_id string, key_hash string, main_revision bigint, sub_revision bigint, storage_prefix string, api_group string, resource string, namespace string, object_name string, display_name string, crd boolean, cluster_scoped boolean, sensitive boolean, content_type string, decode_status string, value_bytes bigint, fields {FIELD}"


@pytest.fixture(scope="module")
def cluster(spark):
    data = [revision("pod", 1, 100, "decoded_protobuf", [("status", 10, "old"), ("spec", 100, "same")]), revision("pod", 2, 200, "decoded_json", [("status", 20, "new"), ("spec", 100, "same")]), revision("ns1", 3, 40, "decoded_json"), revision("ns2", 4, 50, "decoded_json"), revision("secret", 5, 80, "encrypted")]
    own = spark.createDataFrame(data, SCHEMA)
    log = own.select("key_hash", "main_revision", "sub_revision", F.lit(False).alias("tombstone")).union(spark.createDataFrame([("secret", 6, 0, True)], "a string, b bigint, c bigint, d boolean"))
    return own, O.object_records(own, log)


def test_aggregates(cluster):
    own, records = cluster
    s = O.kube_summary(records, own).first()
    assert (s.current_objects, s.decoded_json, s.decoded_protobuf, s.encrypted, s.decode_failures) == (3, 3, 1, 1, 0)
    found = {r.key_hash: r for r in records.collect()}
    assert len(found) == 4 and (found["secret"].present, found["secret"].historical_bytes, found["secret"].object_name, found["secret"].revision_count) == (False, 80, "redacted:x", 2)
    assert (found["pod"].current_bytes, found["pod"].historical_bytes, found["pod"].largest_field_path, found["pod"].largest_field_bytes) == (200, 100, "spec", 100)
    assert (found["ns1"].largest_field_path, found["ns1"].largest_field_bytes) == ("", 0)
    top = O.top_resources(O.resource_stats(records), 1).first()
    assert (top.resource, top.current_objects) == ("pods", 1) and O.namespace_stats(records).count() == 2
    diff = O.adjacent_field_diff(own).collect()
    assert [(d.key_hash, d.previous_main_revision, d.current_main_revision, d.modified_paths, d.status_only) for d in diff] == [("pod", 1, 2, ["status"], True)]


def test_busy_keys_are_cut(spark):
    """Pairs of neighbours do not depend on the spans that a key's revisions are cut into."""
    field = "array<struct<path:string,byte_size:bigint,type_class:string,hash:string>>"
    data = [("t", key, rev, sub, [("spec", 5 + rev % 3, "object", f"h{rev % 4}")]) for key in ("a", "b") for rev, sub in [(1, 0), (2, 0), (2, 1), (9, 0), (10, 0), (31, 0), (32, 0), (95, 0)] if key == "a" or rev > 8]
    own = spark.createDataFrame(data, f"task_id string, key_hash string, main_revision bigint, sub_revision bigint, fields {field}")
    told = lambda span: sorted(map(str, O.adjacent_field_diff(own, span).collect()))
    assert len(told(1 << 16)) == 7 + 4 and told(1 << 16) == told(10) == told(1)


def test_queries(cluster):
    own, records = cluster
    assert [r.key_hash for r in O.query_objects(records, own, category="status").collect()] == ["pod"]
    assert [r.key_hash for r in O.query_objects(records, resource="namespaces", sort="current_bytes").collect()] == ["ns2", "ns1"]
    assert O.query_objects_total(records, decode_status="encrypted", min_bytes=81).first()[0] == 0
    assert O.objects_with_field(records, own, "stat").count() == 0
    history = O.object_history(own, "pod").collect()
    assert [(h.main_revision, h.previous_main_revision, h.fields[0].path) for h in history] == [(2, 1, "spec"), (1, None, "spec")]
    assert [(r.path, r.byte_size) for r in O.top_fields(own, records, 5).collect()] == [("spec", 100), ("status", 20)]
    assert O.revisions_left_join_fields(own).filter("path is null").count() == 3


DIFFS = [
    ([("metadata.managedFields", 10, "a")], [("metadata.managedFields", 20, "b")], ([], [], ["metadata.managedFields"], 10), {"managed_fields_only"}),
    ([("status", 20, "a"), ("status.heartbeatTime", 10, "b")], [("status", 22, "c"), ("status.heartbeatTime", 12, "d")], ([], [], ["status", "status.heartbeatTime"], 4), {"status_only", "timestamp_only"}),
    ([("spec.z", 2, "z"), ("spec.b", 1, "b")], [("spec.a", 3, "a"), ("spec.b", 2, "changed")], (["spec.a"], ["spec.z"], ["spec.b"], 2), set()),
    ([("metadata.creationTimestamp", 12, "a"), ("spec", 3, "x")], [("metadata.creationTimestamp", 12, "b"), ("spec", 3, "y")], ([], [], ["metadata.creationTimestamp", "spec"], 0), {"timestamp_only"}),
    ([("spec", 3, "x")], [("spec", 3, "y")], ([], [], ["spec"], 0), set()),
    ([("a", 1, "x")], [("a", 1, "x")], ([], [], [], 0), set()),
    ([], [("statusx", 1, "x")], (["statusx"], [], [], 1), set()),
]


def test_field_diffs(spark):
    typed = lambda fs: [(p, b, "string", h) for p, b, h in fs]
    df = spark.createDataFrame([(i, typed(a), typed(b)) for i, (a, b, *_) in enumerate(DIFFS)], f"i int, a {FIELD}, b {FIELD}")
    found = df.select("i", O.compare_fields(F.col("a"), F.col("b")).alias("d")).select("i", "d", O.diff_flags(F.concat("d.added_paths", "d.removed_paths", "d.modified_paths")).alias("f")).orderBy("i").collect()
    for r, (_, _, expected, flags) in zip(found, DIFFS, strict=True):
        assert (r.d.added_paths, r.d.removed_paths, r.d.modified_paths, r.d.byte_delta) == expected
        assert {n for n in ("managed_fields_only", "status_only", "timestamp_only") if r.f[n]} == flags


def test_sizes_without_values_taken_apart(spark):
    """Records for diffs are those of whole object revisions, and no value reaches a Python worker."""
    from kvspace.plans import domain as d

    revs = d.revisions(spark, "/root/testdata/sf0.001", with_value=True)
    light, whole = O.object_sizes(revs), O.with_largest(O.object_revisions(revs))
    plan = light._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    unseen = ("decode_status", "largest_field_path", "largest_field_bytes")
    a, b = (O.object_records(o, revs.drop("value")).drop(*unseen).select(sorted(set(O.object_records(o, revs.drop("value")).columns) - set(unseen))).collect() for o in (light, whole))
    assert len(a) > 10 and sorted(a) == sorted(b)
