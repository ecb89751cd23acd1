"""The tables of a report, with sensitive names taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvspace.functions.keys import redact_report_key
from kvspace.operators import objects, revisions
from kvspace.session import stored

ROWS = 20
#: Each section's columns in the report, and what its rows are ranked by (a leading minus: downwards).
SECTIONS = {
    "keys_by_current": (("key_hash", "key_text", "current_stored_bytes", "historical_bytes", "revision_count"), ("-current_stored_bytes", "key_hash")),
    "keys_by_history": (("key_hash", "key_text", "current_stored_bytes", "historical_bytes", "revision_count"), ("-historical_bytes", "key_hash")),
    "prefixes": (("prefix", "current_key_count", "current_bytes", "historical_bytes"), ("-historical_bytes", "-current_bytes", "prefix")),
    "resources": (("api_group", "resource", "current_objects", "current_bytes", "historical_bytes"), ("-current_bytes", "-historical_bytes", "api_group", "resource")),
    "namespaces": (("namespace", "current_objects", "current_bytes", "historical_bytes"), ("-current_bytes", "-historical_bytes", "namespace")),
    "objects": (("key_hash", "display_name", "current_bytes", "historical_bytes", "revision_count"), ("-historical_bytes", "key_hash")),
    "fields": (("key_hash", "display_name", "path", "byte_size"), ("-byte_size", "path", "key_hash")),
}


def redact_report_keys(df: DataFrame, key: str = "key_text", key_hash: str | None = "key_hash") -> DataFrame:
    """df with sensitive key texts redacted; a prefix has no hash."""
    return df.withColumn(key, redact_report_key(F.col(key), F.col(key_hash) if key_hash else F.lit("")))


def report_sections(key_records: DataFrame, prefix_stats: DataFrame, object_records: DataFrame, object_revisions: DataFrame, n: int = ROWS) -> dict[str, DataFrame]:
    return {
        "keys_by_current": redact_report_keys(revisions.query_keys(key_records, "current_bytes", size=n)),
        "keys_by_history": redact_report_keys(revisions.query_keys(key_records, "historical_bytes", size=n)),
        "prefixes": redact_report_keys(revisions.top_prefixes(prefix_stats, n), "prefix", None),
        "resources": objects.top_resources(objects.resource_stats(object_records), n),
        "namespaces": objects.top_namespaces(objects.namespace_stats(object_records), n),
        "objects": objects.query_objects(object_records, size=n),
        "fields": objects.top_fields(object_revisions, object_records, n),
    }


def report_table(key_records: DataFrame, object_records: DataFrame, object_revisions: DataFrame, n: int = ROWS) -> DataFrame:
    """(section, rank, row) of all sections: a row is the JSON text of its section's columns.

    The records are stored once and all sections read them. Ranks are given to the n rows of a
    section after they are chosen.
    """
    keys, own = stored(key_records, "keys"), stored(object_records, "objects")
    out = None
    for name, df in report_sections(keys, revisions.prefix_stats(keys), own, object_revisions, n).items():
        columns, order = SECTIONS[name]
        ranked = Window.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order])
        # redacted texts replace keys after the order is found, so ties end in what is not redacted
        one = df.select(F.lit(name).alias("section"), F.row_number().over(ranked).alias("rank"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"))
        out = one if out is None else out.unionByName(one)
    assert out is not None
    return out
