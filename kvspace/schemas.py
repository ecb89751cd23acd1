"""Schemas of the tables, and the closed lists of their values."""

from __future__ import annotations

KV = "rev_key binary, kv struct<key:binary,value:binary,create_revision:bigint,mod_revision:bigint,version:bigint,lease:bigint>, encoded_bytes bigint"
REVISIONS = "task_id string, key_hash string, key_text string, key_bytes bigint, main_revision bigint, sub_revision bigint, create_revision bigint, mod_revision bigint, version bigint, lease_id bigint, value_bytes bigint, stored_bytes bigint, tombstone boolean, value_hash string"
FIELDS = "array<struct<path:string,byte_size:bigint,type_class:string,hash:string>>"
PAGES = "task_id string, page_id bigint, page_type string, overflow bigint, total_bytes bigint, used_bytes bigint, free_bytes bigint, utilization double"
BUCKETS = "task_id string, bucket_path string, depth bigint, key_count bigint, branch_bytes bigint, leaf_bytes bigint, overflow_bytes bigint, total_bytes bigint, used_bytes bigint"
AUDIT_JSON = (
    "auditID string, stage string, stageTimestamp timestamp, requestReceivedTimestamp timestamp, verb string, user struct<username:string>, userAgent string, sourceIPs array<string>,"
    " objectRef struct<apiVersion:string,resource:string,subresource:string,namespace:string,name:string>, responseStatus struct<code:int>"
)
MATRIX = "status string, data struct<resultType:string,result:array<struct<metric:map<string,string>,values:array<array<string>>>>>"

# The closed lists.
EVENT_TYPES = (
    "nospace quota_exceeded compaction defrag slow_fdatasync wal_fsync slow_backend_commit slow_apply leader_change request_timeout"
    " snapshot_restore snapshot_save lease_revoke corruption_check large_request backend_commit unknown"
).split()
METRIC_TYPES = ("db_total_bytes", "db_in_use_bytes", "quota_bytes", "put_total", "delete_total", "backend_commit_seconds", "wal_fsync_seconds")
CHANGE_TYPES = ("added", "deleted", "modified")
