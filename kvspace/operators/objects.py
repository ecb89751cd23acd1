"""Kubernetes objects behind registry keys: revisions with field statistics, rollups and field diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspace.functions import keys, values
from kvspace.functions.steps import computed_once
from kvspace.operators.paging import page, page_total
from kvspace.session import stored

# Names of fields that hold times.
TIMESTAMPS = ("creationTimestamp", "deletionTimestamp", "lastTimestamp", "eventTime", "heartbeatTime", "renewTime", "lastTransitionTime", "lastUpdateTime")
#: Revisions up to which the neighbours of one key are paired in one task, and busier keys up to which they are broadcast.
SPAN, BROADCAST_KEYS = 1 << 16, 200_000
_LATEST = ("main_revision", "sub_revision")
CATEGORIES = {"managedFields": "metadata.managedFields", "annotations": "metadata.annotations", "labels": "metadata.labels", "spec": "spec", "status": "status", "data": "data", "binaryData": "binaryData"}


_IDENTITY = (("storage_prefix", "storage_prefix"), ("api_group", "api_group"), ("resource", "resource"), ("namespace", "namespace"), ("name", "object_name"), ("display_name", "display_name"), ("crd", "crd"), ("cluster_scoped", "cluster_scoped"), ("sensitive", "sensitive"))


def _identified(revisions: DataFrame) -> DataFrame:
    """The puts of registry objects, with their identity ``_i``."""
    puts = computed_once(revisions.filter(~F.col("tombstone")), {"_p": keys.registry_parts(F.col("key_text"))})
    return computed_once(puts, {"_i": keys.registry_identity(F.col("key_text"), F.col("key_hash"), F.col("_p"))}).filter(F.col("_i").isNotNull())


def object_revisions(revisions: DataFrame, *more: str) -> DataFrame:
    """Object revisions of puts (revisions with ``value``), with identity, status and fields, without the value.

    Only values that classify as JSON objects reach the Python worker. The parts of a key, its
    identity and its value's class are each computed once for a row. ``more`` names columns to keep.
    """
    classed = computed_once(_identified(revisions), {"_c": values.classify_value(F.col("value"), F.col("_i"))})
    is_json = F.col("_c.decode_status") == "decoded_json"
    done = classed.withColumn("_f", values.field_stats(F.when(is_json, F.col("value").cast("string"))))
    return done.select(
        "task_id", "key_hash", "main_revision", "sub_revision",
        *[F.col(f"_i.{a}").alias(b) for a, b in _IDENTITY],
        F.col("_c.content_type").alias("content_type"),
        F.when(is_json, F.col("_f.status")).otherwise(F.col("_c.decode_status")).alias("decode_status"),
        F.octet_length("value").cast("bigint").alias("value_bytes"),
        F.when(is_json, F.col("_f.fields")).otherwise(F.array().cast("array<struct<path:string,byte_size:bigint,type_class:string,hash:string>>")).alias("fields"),
        *more,
    )


def object_sizes(revisions: DataFrame, *more: str) -> DataFrame:
    """What object_revisions tells without looking into values: identity and size. Status and largest field are null, and there are no fields.

    Records for diffs need no more, and no value is parsed or reaches a Python worker.
    """
    unseen = [F.lit(None).cast("string").alias("decode_status"), F.lit(None).cast("struct<path:string,byte_size:bigint>").alias("largest")]
    return _identified(revisions).select("task_id", "key_hash", "main_revision", "sub_revision", *[F.col(f"_i.{a}").alias(b) for a, b in _IDENTITY], *unseen, F.octet_length("value").cast("bigint").alias("value_bytes"), *more)


def largest_field(fields: Column) -> Column:
    """(path, byte_size) of the largest field; the least path of equals."""
    ordered = F.array_sort(F.transform(fields, lambda f: F.struct((-f["byte_size"]).alias("b"), f["path"].alias("path"))))
    first = F.get(ordered, F.lit(0))
    return F.struct(F.coalesce(first["path"], F.lit("")).alias("path"), F.coalesce(-first["b"], F.lit(0).cast("bigint")).alias("byte_size"))


def with_largest(objects: DataFrame) -> DataFrame:
    """objects with their largest field in a column of its own, so that what reads no other field may leave ``fields`` out."""
    return objects.withColumn("largest", largest_field(F.col("fields")))


def revisions_left_join_fields(objects: DataFrame) -> DataFrame:
    """One row for each field of each object revision; a revision without fields has one row of nulls."""
    return objects.select("key_hash", *_LATEST, F.explode_outer("fields").alias("f")).select("key_hash", *_LATEST, "f.*")


def object_records(objects: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row for each object, from its latest revision of each kind; each side is one grouped aggregate by key."""
    kept = ["task_id", *_LATEST, "storage_prefix", "api_group", "resource", "namespace", "object_name", "display_name", "crd", "cluster_scoped", "sensitive", "decode_status", "value_bytes"]
    largest = F.col("largest") if "largest" in objects.columns else largest_field(F.col("fields"))
    semantic = objects.withColumn("_largest", largest).groupBy("key_hash").agg(F.max_by(F.struct(*kept, "_largest"), F.struct(*_LATEST)).alias("s"), F.sum("value_bytes").alias("all_bytes"))
    mvcc = revisions.groupBy("key_hash").agg(F.max_by(F.struct(*_LATEST, "tombstone"), F.struct(*_LATEST)).alias("m"), F.count("*").alias("revision_count"))
    live = ~F.col("m.tombstone")
    same = live & (F.col("s.main_revision") == F.col("m.main_revision")) & (F.col("s.sub_revision") == F.col("m.sub_revision"))
    now = F.when(same, F.col("s.value_bytes")).otherwise(F.lit(0).cast("bigint"))
    name = F.when(F.col("s.sensitive"), F.col("s.display_name")).otherwise(F.col("s.object_name"))
    out = ["storage_prefix", "api_group", "resource", "namespace"]
    return semantic.join(mvcc, "key_hash").select(
        F.col("s.task_id").alias("task_id"), "key_hash", *[F.col(f"s.{c}").alias(c) for c in out], name.alias("object_name"),
        *[F.col(f"s.{c}").alias(c) for c in ("display_name", "crd", "cluster_scoped", "sensitive", "decode_status")],
        live.alias("present"), now.alias("current_bytes"), (F.col("all_bytes") - now).alias("historical_bytes"), "revision_count",
        F.col("s._largest.path").alias("largest_field_path"), F.col("s._largest.byte_size").alias("largest_field_bytes"),
    )


def _rollup(records: DataFrame, *by: str) -> DataFrame:
    return records.groupBy(*by).agg(F.count_if("present").alias("current_objects"), F.sum("current_bytes").alias("current_bytes"), F.sum("historical_bytes").alias("historical_bytes"))


def resource_stats(records: DataFrame) -> DataFrame:
    return _rollup(records, "api_group", "resource")


def namespace_stats(records: DataFrame) -> DataFrame:
    """By namespace; the empty one holds cluster-scoped objects."""
    return _rollup(records, "namespace")


def kube_summary(records: DataFrame, objects: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    status = lambda *s: F.count_if(F.col("decode_status").isin(*s))
    known = ("decoded_json", "decoded_protobuf", "encrypted")
    left = records.agg(F.lit(True).alias("semantic_available"), F.count_if("present").alias("current_objects"), total("current_bytes"), total("historical_bytes"))
    right = objects.agg(*[status(s).alias(n) for s, n in zip(known, ("decoded_json", "decoded_protobuf", "encrypted"), strict=True)], F.count_if(~F.col("decode_status").isin(*known)).alias("decode_failures"))
    return left.crossJoin(F.broadcast(right))


def compare_fields(before: Column, after: Column) -> Column:
    """Struct of the paths added, removed and modified between two field arrays, and the change of bytes."""
    paths = lambda fields: F.transform(fields, lambda f: f["path"])
    table = lambda fields: F.map_from_arrays(paths(fields), F.transform(fields, lambda f: F.struct(f["byte_size"].alias("b"), f["hash"].alias("h"))))
    old, new = table(before), table(after)
    added, removed = F.array_sort(F.array_except(paths(after), paths(before))), F.array_sort(F.array_except(paths(before), paths(after)))
    modified = F.array_sort(F.filter(F.array_intersect(paths(before), paths(after)), lambda p: F.try_element_at(old, p) != F.try_element_at(new, p)))
    size = lambda fields: F.aggregate(fields, F.lit(0).cast("bigint"), lambda a, f: a + f["byte_size"])
    # equal fields cancel out, so the change is the difference of the sums
    return F.struct(added.alias("added_paths"), removed.alias("removed_paths"), modified.alias("modified_paths"), (size(after) - size(before)).alias("byte_delta"))


def diff_flags(changed: Column) -> Column:
    """Struct of what the changed paths have in common; no flag holds without a change."""
    below = lambda p, top: (p == top) | p.startswith(top + ".")
    some = F.size(changed) > 0
    counted = F.filter(changed, lambda p: ~p.isin("metadata", "spec", "status"))
    timed = "(^|[.])(" + "|".join(TIMESTAMPS) + ")$"
    return F.struct(
        (some & F.forall(changed, lambda p: below(p, "metadata.managedFields"))).alias("managed_fields_only"),
        (some & F.forall(changed, lambda p: below(p, "status"))).alias("status_only"),
        ((F.size(counted) > 0) & F.forall(counted, lambda p: p.rlike(timed))).alias("timestamp_only"),
    )


def adjacent_field_diff(objects: DataFrame, span: int = SPAN) -> DataFrame:
    """Each object revision against the one before it of the same key.

    A window of each key pairs neighbours. Keys of more than ``span`` revisions are found first
    (a count of keys alone, which reads no fields; at most one in ``span`` rows is one), and are
    cut into spans of revision numbers, so that a key that is written all the time is no task
    of its own: a span's first revision gets the last one of the span before it. Other keys carry
    nothing.
    """
    busy = stored(objects.groupBy("key_hash").agg(F.count("*").alias("n")).filter(F.col("n") > span).select("key_hash"), "busy")
    some = busy.limit(BROADCAST_KEYS + 1).count()
    kept = ["task_id", "key_hash", *_LATEST, "fields"]
    if some:
        marked = busy.withColumn("_busy", F.lit(True))
        joined = objects.join(F.broadcast(marked) if some <= BROADCAST_KEYS else marked, "key_hash", "left")
        spans = joined.select(*kept, F.when(F.col("_busy"), F.floor(F.col("main_revision") / span)).alias("_span"))
    else:
        spans = objects.select(*kept, F.lit(None).cast("bigint").alias("_span"))
    by = Window.partitionBy("key_hash", "_span").orderBy(*_LATEST)
    rows = spans.withColumns({"_before": F.lag("fields").over(by), "previous_main_revision": F.lag("main_revision").over(by)})
    if some:
        rows = rows.withColumn("_last", F.lead("main_revision").over(by).isNull() & F.col("_span").isNotNull())
        over = Window.partitionBy("key_hash").orderBy("_span")
        # all columns of a row are carried, so that both uses of ``rows`` have the same shuffle, which is then made once
        carried = rows.filter("_last").select("key_hash", "_span", F.lag(F.struct("task_id", *_LATEST, "fields")).over(over).alias("_carried"))
        joined = rows.join(carried, ["key_hash", "_span"], "left")
        rows = joined.withColumns({"_before": F.coalesce("_before", "_carried.fields"), "previous_main_revision": F.coalesce("previous_main_revision", "_carried.main_revision")})
    own = rows.filter(F.col("_before").isNotNull()).select("task_id", "key_hash", "previous_main_revision", F.col("main_revision").alias("current_main_revision"), "_before", "fields")
    # the comparison walks over both arrays several times, so it and the flags are not repeated for each column of theirs
    diffed = computed_once(own, {"d": compare_fields(F.col("_before"), F.col("fields"))}).drop("_before", "fields").select("*", "d.*").drop("d")
    changed = F.concat("added_paths", "removed_paths", "modified_paths")
    flagged = computed_once(computed_once(diffed, {"_changed": changed}), {"x": diff_flags(F.col("_changed"))})
    return flagged.drop("_changed").select("*", "x.*").drop("x")


OBJECT_SORTS = {"name": "display_name", "current_bytes": "current_bytes", "historical_bytes": "historical_bytes", "revision_count": "revision_count", "largest_field": "largest_field_bytes"}


def objects_with_field(records: DataFrame, objects: DataFrame, path: str) -> DataFrame:
    """Objects that have a field at or below the path in any revision."""
    having = objects.filter(F.exists("fields", lambda f: keys.field_path_filter(f["path"], path))).select("key_hash")
    return records.join(having, "key_hash", "left_semi")


def filter_objects(records: DataFrame, objects: DataFrame | None = None, api_group: str | None = None, resource: str | None = None, namespace: str | None = None, decode_status: str | None = None, min_bytes: int = 0, min_revisions: int = 0, category: str | None = None) -> DataFrame:
    out = records
    for column, value in (("api_group", api_group), ("resource", resource), ("namespace", namespace), ("decode_status", decode_status)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if min_bytes:
        out = out.filter(F.col("current_bytes") + F.col("historical_bytes") >= min_bytes)
    if min_revisions:
        out = out.filter(F.col("revision_count") >= min_revisions)
    if category is not None:
        if objects is None:
            raise ValueError("a field category needs the object revisions")
        out = objects_with_field(out, objects, CATEGORIES[category])
    return out


def query_objects(records: DataFrame, objects: DataFrame | None = None, sort: str = "historical_bytes", descending: bool = True, number: int = 1, size: int = 100, **filters) -> DataFrame:
    return page(filter_objects(records, objects, **filters), OBJECT_SORTS, sort, descending, ("key_hash",), number, size)


def query_objects_total(records: DataFrame, objects: DataFrame | None = None, **filters) -> DataFrame:
    return page_total(filter_objects(records, objects, **filters))


def get_object(records: DataFrame, key_hash: str) -> DataFrame:
    return records.filter(F.col("key_hash") == key_hash)


def object_history(objects: DataFrame, key_hash: str) -> DataFrame:
    """An object's revisions, newest first, each with its fields (largest first) and its diff to the one before."""
    own = objects.filter(F.col("key_hash") == key_hash)
    diffs = adjacent_field_diff(own).withColumnRenamed("current_main_revision", "main_revision").drop("task_id")
    ordered = F.transform(F.array_sort(F.transform("fields", lambda f: F.struct((-f["byte_size"]).alias("b"), f["path"].alias("path"), f.alias("f")))), lambda s: s["f"])
    return own.withColumn("fields", ordered).join(diffs, ["key_hash", "main_revision"], "left").orderBy(F.desc("main_revision"), F.desc("sub_revision"))


def top_resources(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(F.desc("current_bytes"), F.desc("historical_bytes"), "api_group", "resource").limit(n)


def top_namespaces(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(F.desc("current_bytes"), F.desc("historical_bytes"), "namespace").limit(n)


def top_fields(objects: DataFrame, records: DataFrame, n: int) -> DataFrame:
    """The largest fields in the latest revisions of present objects."""
    last = objects.groupBy("key_hash").agg(F.max_by("fields", F.struct(*_LATEST)).alias("fields"))
    live = records.filter("present").select("key_hash", "api_group", "resource", "namespace", "display_name")
    return last.join(live, "key_hash").select("key_hash", "api_group", "resource", "namespace", "display_name", F.explode("fields").alias("f")).select("*", "f.path", "f.byte_size", "f.type_class").drop("f").orderBy(F.desc("byte_size"), "path", "key_hash").limit(n)
