"""Keyed state: requests told once, differences of prefix statistics."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kvspace.operators import audit as A
from kvspace.operators import revisions as R
from kvspace.streaming import streams as S
from tests.conftest import rows
from tests.test_audit import events, line, sha


def arriving(spark, df_of_each, folder, per_trigger=1):
    """A stream of the given tables, one file each, in this order."""
    import os

    for k, df in enumerate(df_of_each):
        df.coalesce(1).write.parquet(f"{folder}/{k:03d}")
        for name in os.listdir(f"{folder}/{k:03d}"):
            os.utime(f"{folder}/{k:03d}/{name}", (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(df_of_each[0].schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(str(folder))


def test_ids_are_told_once_across_days_and_batches(spark, tmp_path):
    batches = [
        [line(auditID="c", stage="RequestReceived", stageTimestamp="2026-08-03T23:59:59Z", responseStatus={"code": 0}), line(auditID="a", stageTimestamp="2026-08-03T10:00:00Z")],
        [line(auditID="c", stageTimestamp="2026-08-04T00:00:01Z", responseStatus={"code": 201})],
        [line(auditID="d", stageTimestamp="2026-08-04T12:00:00Z"), line(auditID="c", stage="RequestReceived", stageTimestamp="2026-08-04T11:00:00Z")],
    ]
    each = [events(spark, *b)[1].withColumn("line_number", F.col("line_number") + 10 * k) for k, b in enumerate(batches)]
    stream = S.audit_dedup_stream(arriving(spark, [*each, S.end_of_events(each[0])], tmp_path / "in"))
    told = S.run_available(stream, str(tmp_path / "run"))
    whole = each[0].unionByName(each[1]).unionByName(each[2])
    assert told.count() == 3 and rows(told.drop("batch")) == rows(A.audit_dedup(whole).select(*told.drop("batch").columns))
    assert {r.audit_id_hash: r.response_code for r in told.collect()}[sha("c")] == 201


def test_late_rows_and_stragglers_drop(spark, tmp_path):
    at = lambda hour, **more: line(stageTimestamp=f"2026-08-03T{hour:02d}:00:00Z", **more)
    batches = [
        [at(1, auditID="a", responseStatus={"code": 1})],
        [at(6, auditID="b")],
        [at(2, auditID="late"), at(6, auditID="b", stage="RequestReceived")],  # two hours behind six o'clock is the limit
        [at(4, auditID="a", responseStatus={"code": 2})],  # a was told at three o'clock, and is known until five
        [at(20, auditID="e")],
        [at(23, auditID="a", responseStatus={"code": 3})],  # forgotten by now: a new id
    ]
    each = [events(spark, *b)[1] for b in batches]
    told = S.run_available(S.audit_dedup_stream(arriving(spark, [*each, S.end_of_events(each[0])], tmp_path / "in"), "2 hours"), str(tmp_path / "run"))
    found = sorted((r.audit_id_hash, r.response_code, r.stage_rank) for r in told.collect() if r.audit_id_hash in (sha("a"), sha("late")))
    assert [(h, c) for h, c, _ in found] == [(sha("a"), 1), (sha("a"), 3)]
    assert told.filter(F.col("audit_id_hash") == sha("b")).count() == 1


def test_open_ids_stay_in_state(spark, tmp_path):
    own = events(spark, line(auditID="a"))[1]
    assert S.run_available(S.audit_dedup_stream(arriving(spark, [own], tmp_path / "in")), str(tmp_path / "run")).count() == 0


def revisions(spark, n, seed):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        key, dead = f"/registry/pods/ns{rng.randint(0, 2)}/p{rng.randint(0, 5)}", rng.random() < 0.2
        size = 0 if dead else rng.randint(1, 50)
        made.append(("t", sha(key), key, len(key), rng.randint(1, 40), i % 3, 1, 1, 1, 0, size, size + 20, dead, sha(str(i))))
    return spark.createDataFrame(made, "task_id string, key_hash string, key_text string, key_bytes bigint, main_revision bigint, sub_revision bigint, create_revision bigint, mod_revision bigint, version bigint, lease_id bigint, value_bytes bigint, stored_bytes bigint, tombstone boolean, value_hash string")


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_statistics_follow_revisions(spark, tmp_path, seed):
    """After each batch the statistics are those of all revisions up to it, whatever the order; the largest value also falls."""
    each = [revisions(spark, 30, 10 * seed + k) for k in range(3)]
    told = S.run_available(S.prefix_stats_stream(arriving(spark, each, tmp_path / "in")), str(tmp_path / "run"), "update", S.prefix_differences).cache()
    whole = None
    for k, part in enumerate(each):
        whole = part if whole is None else whole.unionByName(part)
        want = R.prefix_stats(R.key_records(whole))
        assert rows(S.prefix_current(told.filter(F.col("batch") <= k)).select(*want.columns)) == rows(want)
    raw = S.run_available(S.prefix_stats_stream(arriving(spark, each, tmp_path / "again")), str(tmp_path / "run2"), "update")
    assert {r.sign for r in raw.select("sign").distinct().collect()} == {-1, 1}
    assert rows(S.prefix_current(raw.drop("batch"))) == rows(S.prefix_current(told))


class _Held:
    """A handle and its one value, counting what is asked of them."""

    def __init__(self):
        self.value, self.calls, self.timers = None, 0, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.now


def test_state_is_asked_for_parts_and_not_for_ids(spark):
    from pyspark.sql.types import StructType

    from kvspace.streaming.state import BestOnce

    own, held = BestOnce(StructType.fromDDL("task string, id string, at bigint, rank int"), ("task", "id"), "at", ("rank",), 10), _Held()
    own.init(held)
    arrived = [("t", f"i{k % 500}", 100 + k % 500 % 3, k // 500, 0) for k in range(1000)] + [("t", None, 100, 9, 0)]
    assert list(own.handleInputRows((0,), iter(arrived), _Clock(0))) == []
    assert held.calls == 3 and held.timers == [110]
    told = list(own.handleExpiredTimer((0,), _Clock(111), None))
    assert held.calls <= 6 and sorted((r.id, r["rank"]) for r in told) == sorted((f"i{k}", 1) for k in range(500) if k % 3 < 2)
