"""Registered queries: names, SQL for each, no planted text in results, tables by task."""

from __future__ import annotations

import __spark_entry__ as entry
from kvspace.operators import revisions
from kvspace.plans import catalog, domain
from kvspace.sources import readers

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_outputs_hold_no_values(spark):
    """Values, request bodies, whole addresses and agents stay out of what the operators return."""
    for name in ("decode_revisions", "object_records", "log_normalize", "audit_normalize"):
        text = " ".join(str(r) for r in catalog.QUERIES[name](spark, SF).collect())
        assert "renewTime\":" not in text and "(linux) tail" not in text and "aescbc" not in text, name


def test_tables_by_task(spark, tmp_path):
    records = revisions.key_records(domain.revisions(spark, SF))
    one, two = records.selectExpr("key_hash", "'1' AS task_id"), records.selectExpr("key_hash", "'2' AS task_id")
    path = str(tmp_path)
    readers.write_tables({"k": one}, path)
    readers.write_tables({"k": two}, path)
    readers.write_tables({"k": two.limit(1)}, path)
    assert readers.read_table(spark, path, "k", "1").count() == records.count() and readers.read_table(spark, path, "k", "2").count() == 1
