"""Domain inputs derived from general tables: a store's revisions, logs, requests, metrics and pages.

Everything is computed by Spark from all rows of events, lineitem and orders. PRELUDE holds
the same derivations as common table expressions of DuckDB.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE_AT, COMPACT_AT = "2024-01-15 00:00:00", "2024-01-05 00:00:00"
FROM, TO = datetime(2024, 1, 10), datetime(2024, 1, 20)
RESET_AT = "2024-01-15 00:00:00"
PAGE_SIZE = 4096
#: Rows of a task that works long on each of them, and of one that does not.
HEAVY_ROWS, LIGHT_ROWS = 50_000, 500_000
KINDS = ("pods", "deployments", "secrets", "nodes", "widgets")
_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, rows: int, least: int = 1) -> DataFrame:
    """df dealt by ``key`` to tasks of about ``rows`` rows, ``least`` tasks at least.

    Files are split by bytes, but a row group is read by one task: a table of few large row
    groups has few tasks with rows in them, however many splits it has.
    """
    parts = -(-df.count() // rows)
    return df.repartition(max(parts, least), key) if max(parts, least) > 1 else df


def events(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Events with what is derived from them; ``heavy`` if what follows works long on each row."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = spread(e, "event_id", HEAVY_ROWS, spark.sparkContext.defaultParallelism) if heavy else spread(e, "event_id", LIGHT_ROWS)
    user, kind = F.col("user_id"), F.col("user_id") % 5
    ns, name = F.concat(F.lit("ns"), (user % 7).cast("string")), F.concat(F.lit("obj-"), user.cast("string"))
    folder = F.when(kind == 4, "example.io/widgets").otherwise(F.get(F.array(*[F.lit(k) for k in KINDS]), kind.cast("int")))
    key = F.concat_ws("/", F.lit("/registry"), folder, F.when(kind != 3, ns), name)
    return e.withColumns({"key_text": key, "amount": F.round(F.col("value") * 100).cast("bigint"), "k": F.get_json_object("props", "$.k").cast("bigint"), "iso": F.date_format("ts", _ISO), "tombstone": F.col("event_type") == "error"})


def value_text() -> Column:
    """A JSON object for most puts; some are encrypted, some protobuf."""
    body = F.format_string('{"metadata":{"name":"obj-%d","labels":{"app":"%s"},"creationTimestamp":"2024-01-01T00:00:00Z"},"spec":{"k":%d,"renewTime":"%s"},"status":{"phase":"%s"}}', "user_id", "event_type", "k", "iso", "event_type")
    return F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("k8s:enc:aescbc:v1:key:"), F.col("iso"))).when(F.col("event_id") % 13 == 0, F.concat(F.lit("k8s\x00"), F.col("iso"))).otherwise(body)


def revisions(spark: SparkSession, sf_dir: str, with_value: bool = False) -> DataFrame:
    e = events(spark, sf_dir, with_value)
    size = F.when(F.col("tombstone"), F.lit(0).cast("bigint")).otherwise(F.col("amount"))
    main = (F.col("event_id") + 1).cast("bigint")
    columns = [
        F.lit("store").alias("task_id"), F.sha2("key_text", 256).alias("key_hash"), "key_text", F.octet_length("key_text").cast("bigint").alias("key_bytes"),
        main.alias("main_revision"), F.lit(0).cast("bigint").alias("sub_revision"), main.alias("create_revision"), main.alias("mod_revision"),
        F.lit(1).cast("bigint").alias("version"), F.lit(0).cast("bigint").alias("lease_id"), size.alias("value_bytes"),
        (size + F.octet_length("key_text") + 17).cast("bigint").alias("stored_bytes"), "tombstone", F.sha2(F.concat_ws(":", "key_text", main), 256).alias("value_hash"),
    ]
    return e.select(*columns, "ts", *([value_text().cast("binary").alias("value")] if with_value else []))


def raw_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's rows as exported; one in 97 has a bad key."""
    e = events(spark, sf_dir)
    eight = lambda n: F.lpad(F.hex(n), 16, "0")
    mark = F.when(F.col("event_id") % 97 == 0, "78").when(F.col("tombstone"), "74").otherwise("")
    value = F.when(~F.col("tombstone"), value_text().cast("binary"))
    main = (F.col("event_id") + 1).cast("bigint")
    kv = F.struct(F.col("key_text").cast("binary").alias("key"), value.alias("value"), main.alias("create_revision"), main.alias("mod_revision"), F.lit(1).cast("bigint").alias("version"), F.lit(0).cast("bigint").alias("lease"))
    size = F.octet_length("key_text") + F.coalesce(F.octet_length(value), F.lit(0))
    return e.select(F.unhex(F.concat(eight(main), F.lit("5F"), eight(F.lit(0)), mark)).alias("rev_key"), kv.alias("kv"), size.cast("bigint").alias("encoded_bytes"))


def snapshots(revs: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(baseline, target): the log up to a time; and the whole log, compacted up to an earlier one.

    ``rows`` are what is taken of it, by default the revisions. Only rows that may be compacted
    away are looked up among the last revisions of their keys.
    """
    own = revs if rows is None else rows
    base = own.filter(F.col("ts") <= F.lit(BASE_AT).cast("timestamp"))
    late = F.coalesce(F.col("ts") >= F.lit(COMPACT_AT).cast("timestamp"), F.lit(False))
    last = revs.groupBy("key_hash").agg(F.max("main_revision").alias("main_revision"))
    return base, own.filter(late).unionByName(own.filter(~late).join(last, ["key_hash", "main_revision"], "left_semi"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_number, line) in four formats by turns; some JSON lines have an explicit type, known or not."""
    explicit = F.when(F.col("event_id") % 20 == 0, '","event_type":"LEASE-revoke').when(F.col("event_id") % 12 == 0, '","event_type":"odd').otherwise("")
    n = F.col("event_id").cast("string")
    kind = F.col("event_type")
    message = (
        F.when(kind == "click", F.concat(F.lit("compacted revision "), n))
        .when(kind == "view", F.concat(F.lit("apply request took too long took="), n, F.lit("ms")))
        .when(kind == "signup", "leader changed from 1 to 2")
        .when(kind == "purchase", "mvcc: database space exceeded")
        .otherwise(F.concat(F.lit("hello "), n))
    )
    turn = F.col("event_id") % 4
    line = (
        F.when(turn == 0, F.concat(F.lit('{"ts":"'), "iso", F.lit('","level":"warn","caller":"mvcc","msg":"'), message, explicit, F.lit('","revision":'), n, F.lit("}")))
        .when(turn == 1, F.concat("iso", F.lit(" stdout F "), message))
        .when(turn == 2, F.concat(F.lit("__REALTIME_TIMESTAMP="), "iso", F.lit(" PRIORITY=3 SYSLOG_IDENTIFIER=etcd MESSAGE="), message))
        .otherwise(F.concat("iso", F.lit(" "), message))
    )
    return events(spark, sf_dir, True).select((F.col("event_id") + 1).cast("bigint").alias("line_number"), line.alias("line"))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_number, line): of every three requests two share an id; one line in 97 is broken."""
    e, kind, three = events(spark, sf_dir, True), F.col("user_id") % 5, F.col("event_id") % 3
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), kind.cast("int"))
    audit = F.col("event_id") - F.when(three == 1, 1).otherwise(0)
    verb = F.col("event_type")
    verb = F.when(verb == "click", "update").when(verb == "view", "get").when(verb == "signup", "create").when(verb == "purchase", "Patch").otherwise("delete")
    text = F.format_string(
        '{"auditID":"a%d","stage":"%s","stageTimestamp":"%s","verb":"%s","user":{"username":"user-%d"},"userAgent":"agent/%d (linux) tail","sourceIPs":["10.0.%d.%d"],'
        '"objectRef":{"apiVersion":"%s","resource":"%s","namespace":"%s","name":"obj-%d"},"responseStatus":{"code":200},"requestObject":{"k":%d}}',
        audit, F.when(three == 0, "RequestReceived").otherwise("ResponseComplete"), F.col("iso"), verb, F.col("user_id"), F.col("user_id") % 4, F.col("user_id") % 8, F.col("event_id") % 250,
        pick("v1", "apps/v1", "v1", "v1", "example.io/v1"), pick(*KINDS), F.when(kind == 3, "").otherwise(F.concat(F.lit("ns"), (F.col("user_id") % 7).cast("string"))), F.col("user_id"), F.col("k"),
    )
    return e.select((F.col("event_id") + 1).cast("bigint").alias("line_number"), F.when(F.col("event_id") % 97 == 0, "{bad json}").otherwise(text).alias("line"))


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    hours = e.groupBy(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("instance"), F.date_trunc("hour", "ts").alias("h")).agg(
        F.count("*").alias("n"), F.sum("amount").alias("s"), F.count_if("tombstone").alias("d"), F.count_if(F.col("value") <= 10).alias("b10"), F.count_if(F.col("value") <= 100).alias("b100")
    )
    run = Window.partitionBy("instance").orderBy("h")
    reset = Window.partitionBy("instance", F.col("h") >= F.lit(RESET_AT).cast("timestamp")).orderBy("h")
    total = lambda c, w=run: F.sum(c).over(w)
    return hours.select("instance", "h", (100_000_000 + total("s")).alias("total"), (80_000_000 + F.floor(total("s") / 2)).alias("used"), total("n", reset).alias("puts"), total("d", reset).alias("deletes"), total("b10").alias("b10"), total("b100").alias("b100"), total("n").alias("binf"))


#: (metric name, le, column of the hourly table)
SERIES = (
    ("etcd_mvcc_db_total_size_in_bytes", "", "total"),
    ("etcd_debugging_mvcc_db_total_size_in_bytes", "", "total"),
    ("etcd_mvcc_db_total_size_in_use_in_bytes", "", "used"),
    ("etcd_server_quota_backend_bytes", "", "quota"),
    ("etcd_debugging_mvcc_put_total", "", "puts"),
    ("etcd_mvcc_delete_total", "", "deletes"),
    ("etcd_disk_backend_commit_duration_seconds_bucket", "10", "b10"),
    ("etcd_disk_backend_commit_duration_seconds_bucket", "100", "b100"),
    ("etcd_disk_backend_commit_duration_seconds_bucket", "+Inf", "binf"),
    ("etcd_disk_wal_fsync_duration_seconds_bucket", "bad", "binf"),
    ("process_cpu_seconds_total", "", "binf"),
)


def raw_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, metric, values) as in a range query; one value in a series of three is no number."""
    hours = _hourly(spark, sf_dir).withColumn("quota", F.lit(8_000_000_000))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(le).alias("le"), F.col(c).cast("string").alias("v")) for n, le, c in SERIES]))
    points = hours.select("instance", F.unix_timestamp("h").alias("t"), each.alias("p")).select("instance", "t", "p.*")
    labels = F.map_filter(F.create_map(F.lit("__name__"), F.col("name"), F.lit("instance"), F.col("instance"), F.lit("job"), F.lit("etcd"), F.lit("le"), F.col("le")), lambda k, v: v != "")
    value = F.when((F.col("t") % 86400 == 0) & (F.col("le") == "10"), "NaN").otherwise(F.col("v"))
    return points.groupBy("instance", "name", "le").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", value.alias("v")))), lambda s: F.array(s["t"].cast("string"), s["v"])).alias("values")).select(F.xxhash64("instance", "name", "le").alias("series_id"), labels.alias("metric"), "values")


def pages_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order, of a type by its lines."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("bigint").alias("page_id")).agg(F.count("*").alias("n"), F.min("l_returnflag").alias("f"), F.max("l_linestatus").alias("s"))
    kind = F.when(F.col("page_id") < 3, "meta").when(F.col("page_id") % 50 == 7, "freelist").when(F.col("f") == "R", "free").when(F.col("f") == "A", "leaf").when(F.col("s") == "F", "other").otherwise("branch")
    typed = own.select("page_id", kind.alias("page_type"), (F.col("n") - 1).alias("overflow"))
    total = F.when(F.col("page_type") == "free", F.lit(1)).otherwise(F.col("overflow") + 1) * PAGE_SIZE
    free = F.col("page_type") == "free"
    return typed.select(F.lit("store").alias("task_id"), "page_id", "page_type", "overflow", total.cast("bigint").alias("total_bytes"), F.when(free, 0).otherwise(total).cast("bigint").alias("used_bytes"), F.when(free, total).otherwise(0).cast("bigint").alias("free_bytes"), F.when(free, 0.0).otherwise(1.0).alias("utilization"))


def buckets_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    path = F.concat_ws("/", F.lit("key"), "o_orderstatus", F.replace(F.col("o_orderpriority"), F.lit("/"), F.lit("_")))
    size = lambda m: (F.col("n") * m).cast("bigint")
    return own.select(F.lit("store").alias("task_id"), path.alias("bucket_path"), F.lit(3).cast("bigint").alias("depth"), F.col("n").alias("key_count"), size(10).alias("branch_bytes"), size(90).alias("leaf_bytes"), size(5).alias("overflow_bytes"), size(100).alias("total_bytes"), size(70).alias("used_bytes"))


_KEY = """CASE user_id % 5 WHEN 0 THEN '/registry/pods/ns' || (user_id % 7) WHEN 1 THEN '/registry/deployments/ns' || (user_id % 7) WHEN 2 THEN '/registry/secrets/ns' || (user_id % 7)
 WHEN 3 THEN '/registry/nodes' ELSE '/registry/example.io/widgets/ns' || (user_id % 7) END || '/obj-' || user_id"""

PRELUDE = f"""
ev AS (SELECT *, {_KEY} AS key_text, sha256({_KEY}) AS key_hash, CAST(round(value * 100) AS BIGINT) AS amount, CAST(props->>'k' AS BIGINT) AS k,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, event_type = 'error' AS tombstone, event_id + 1 AS main_revision FROM events),
revisions AS (SELECT 'store' AS task_id, key_hash, key_text, strlen(key_text) AS key_bytes, main_revision, 0 AS sub_revision, tombstone, ts,
  CASE WHEN tombstone THEN 0 ELSE amount END AS value_bytes, CASE WHEN tombstone THEN 0 ELSE amount END + strlen(key_text) + 17 AS stored_bytes FROM ev),
base_rev AS (SELECT * FROM revisions WHERE ts <= TIMESTAMP '{BASE_AT}'),
target_rev AS (SELECT * FROM revisions WHERE ts >= TIMESTAMP '{COMPACT_AT}' OR main_revision = (SELECT max(r.main_revision) FROM revisions r WHERE r.key_hash = revisions.key_hash)),
ident AS (SELECT DISTINCT key_hash, key_text, CASE user_id % 5 WHEN 1 THEN 'apps' WHEN 4 THEN 'example.io' ELSE '' END AS api_group,
  CASE user_id % 5 WHEN 0 THEN 'pods' WHEN 1 THEN 'deployments' WHEN 2 THEN 'secrets' WHEN 3 THEN 'nodes' ELSE 'widgets' END AS resource,
  CASE WHEN user_id % 5 = 3 THEN '' ELSE 'ns' || (user_id % 7) END AS namespace, 'obj-' || user_id AS name,
  CASE WHEN user_id % 5 = 2 THEN 'redacted:' || substr(key_hash, 1, 12) ELSE 'obj-' || user_id END AS display_name FROM ev),
kube AS (SELECT key_hash, main_revision, event_type, k, iso, user_id, ts, CASE WHEN event_id % 11 = 0 THEN 'encrypted' WHEN event_id % 13 = 0 THEN 'protobuf_unsupported' ELSE 'decoded_json' END AS decode_status,
  CASE WHEN event_id % 11 = 0 THEN 42 WHEN event_id % 13 = 0 THEN 24 ELSE strlen('{{"metadata":{{"name":"obj-' || user_id || '","labels":{{"app":"' || event_type || '"}},"creationTimestamp":"2024-01-01T00:00:00Z"}},"spec":{{"k":' || k || ',"renewTime":"' || iso || '"}},"status":{{"phase":"' || event_type || '"}}}}') END AS value_bytes
  FROM ev WHERE NOT tombstone),
fields AS (SELECT key_hash, main_revision, p.path AS path, strlen(p.j) AS byte_size, p.t AS type_class, sha256(p.j) AS hash FROM (SELECT key_hash, main_revision, unnest([
  {{'path': 'metadata.labels', 'j': '{{"app":"' || event_type || '"}}', 't': 'object'}}, {{'path': 'metadata.creationTimestamp', 'j': '"2024-01-01T00:00:00Z"', 't': 'string'}},
  {{'path': 'spec', 'j': '{{"k":' || k || ',"renewTime":"' || iso || '"}}', 't': 'object'}}, {{'path': 'spec.renewTime', 'j': '"' || iso || '"', 't': 'string'}},
  {{'path': 'status', 'j': '{{"phase":"' || event_type || '"}}', 't': 'object'}}, {{'path': 'metadata.name', 'j': '"obj-' || user_id || '"', 't': 'string'}},
  {{'path': 'spec.k', 'j': CAST(k AS VARCHAR), 't': 'number'}}, {{'path': 'status.phase', 'j': '"' || event_type || '"', 't': 'string'}}]) AS p FROM kube WHERE decode_status = 'decoded_json')),
hours AS (SELECT 'm' || (user_id % 3) AS instance, date_trunc('hour', ts) AS h, count(*) AS n, sum(amount) AS s, count(*) FILTER (tombstone) AS d, count(*) FILTER (value <= 10) AS c10, count(*) FILTER (value <= 100) AS c100 FROM ev GROUP BY 1, 2),
grid AS (SELECT instance, CAST(h AS TIMESTAMP) AS h, 100000000 + sum(s) OVER w AS total, 80000000 + floor(sum(s) OVER w / 2) AS used, sum(n) OVER r AS puts, sum(d) OVER r AS deletes, sum(c10) OVER w AS b10, sum(c100) OVER w AS b100, sum(n) OVER w AS binf
  FROM hours WINDOW w AS (PARTITION BY instance ORDER BY h), r AS (PARTITION BY instance, h >= TIMESTAMP '{RESET_AT}' ORDER BY h)),
wide AS (SELECT * FROM grid WHERE h BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}')
"""


def key_records_sql(source: str) -> str:
    """Key records of a revision table, in another way than the operator: by a ranked window."""
    return f"""(SELECT key_hash, max(key_text) AS key_text, bool_or(rn = 1 AND NOT tombstone) AS present,
  sum(CASE WHEN rn = 1 AND NOT tombstone THEN value_bytes ELSE 0 END) AS current_value_bytes, sum(CASE WHEN rn = 1 AND NOT tombstone THEN stored_bytes ELSE 0 END) AS current_stored_bytes,
  count(*) FILTER (NOT tombstone AND rn > 1) AS historical_versions, coalesce(sum(stored_bytes) FILTER (NOT tombstone AND rn > 1), 0) AS historical_bytes,
  count(*) FILTER (tombstone) AS tombstone_count, coalesce(sum(stored_bytes) FILTER (tombstone), 0) AS tombstone_bytes, count(*) AS revision_count
  FROM (SELECT *, row_number() OVER (PARTITION BY key_hash ORDER BY main_revision DESC) AS rn FROM {source}) GROUP BY key_hash)"""


def object_records_sql(revs: str, kube: str) -> str:
    return f"""(SELECT i.*, o.decode_status, NOT m.tombstone AS present, CASE WHEN NOT m.tombstone AND m.main_revision = o.main_revision THEN o.value_bytes ELSE 0 END AS current_bytes,
  t.bytes - CASE WHEN NOT m.tombstone AND m.main_revision = o.main_revision THEN o.value_bytes ELSE 0 END AS historical_bytes, c.n AS revision_count, o.main_revision AS last_main
  FROM (SELECT * FROM {kube} QUALIFY row_number() OVER (PARTITION BY key_hash ORDER BY main_revision DESC) = 1) o
  JOIN (SELECT * FROM {revs} QUALIFY row_number() OVER (PARTITION BY key_hash ORDER BY main_revision DESC) = 1) m USING (key_hash)
  JOIN (SELECT key_hash, sum(value_bytes) AS bytes FROM {kube} GROUP BY 1) t USING (key_hash) JOIN (SELECT key_hash, count(*) AS n FROM {revs} GROUP BY 1) c USING (key_hash) JOIN ident i USING (key_hash))"""
