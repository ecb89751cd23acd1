"""Tables and the catalog at size: tasks and files of bounded rows, values taken apart once."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from kvspace.plans import catalog, domain

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("heavy", "limit"), [(True, "HEAVY_ROWS"), (False, "LIGHT_ROWS")])
def test_rows_of_one_row_group_are_dealt_to_many_tasks(spark, monkeypatch, heavy, limit):
    """The table is one row group, so one split of however many holds all rows."""
    monkeypatch.setattr(domain, limit, 50)
    own = domain.events(spark, SF, heavy)
    sizes = [r["count"] for r in own.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == domain.table(spark, SF, "events").count() and max(sizes) <= 100


def test_files_of_arriving_revisions_are_bounded(spark, monkeypatch):
    """A batch is more files, not larger ones; so is what a task writes."""
    made = []
    real = catalog.scratch_dir
    monkeypatch.setattr(catalog, "scratch_dir", lambda *a: made.append(real(*a)) or made[-1])
    monkeypatch.setattr(catalog, "FILE_ROWS", 100, raising=False)
    told = catalog.prefix_stats_stream(spark, SF)
    files = [f for f in os.listdir(f"{made[0]}/in") if f.endswith(".parquet")]
    assert len(files) == 12
    per_file = spark.read.parquet(f"{made[0]}/in").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert per_file <= 150 and len(os.listdir(f"{made[0]}/state/commits")) >= 4
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, catalog.prefix_stats(spark, SF).collect()))


@pytest.mark.parametrize("name", ["kube_summary", "query_objects_total", "objects_with_field", "top_fields", "report_sections", "diff_kube_summary", "diff_namespaces"])
def test_values_are_taken_apart_once(spark, name):
    """What reads the object revisions several times reads them from a table."""
    assert "ArrowEvalPython" not in _plan(catalog.QUERIES[name](spark, SF))


def test_field_comparison_stands_in_the_plan_once(spark):
    assert _plan(catalog.QUERIES["adjacent_field_diff"](spark, SF)).count("array_except(") <= 4


def test_audit_lines_are_parsed_once_for_the_head(spark, monkeypatch):
    made = []
    monkeypatch.setattr(catalog, "_sets", lambda *a: made.append(a))
    head = catalog.audit_evidence(spark, SF)
    assert "from_json" not in _plan(head) and not made and head.count() == 1
