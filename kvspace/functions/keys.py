"""Key text, key ancestry and Kubernetes registry identity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# API groups of built-in resources, cluster-scoped and sensitive resources.
API_GROUPS = {
    "deployments": "apps", "daemonsets": "apps", "statefulsets": "apps", "replicasets": "apps",
    "jobs": "batch", "cronjobs": "batch",
    "leases": "coordination.k8s.io",
    "ingresses": "networking.k8s.io", "networkpolicies": "networking.k8s.io",
    "storageclasses": "storage.k8s.io", "csinodes": "storage.k8s.io",
}
CLUSTER_SCOPED = ("namespaces", "nodes", "persistentvolumes", "storageclasses", "csinodes")
SENSITIVE = ("secrets", "serviceaccounts", "certificatesigningrequests")


def key_text(key: Column) -> Column:
    """Text of a binary key; ``hex:`` and lower-case hex where it is no UTF-8."""
    return F.when(F.is_valid_utf8(key.cast("string")), key.cast("string")).otherwise(F.concat(F.lit("hex:"), F.lower(F.hex(key))))


def key_ancestors(key: Column) -> Column:
    """Cumulative slash ancestors, nearest to the root first; a key without a leading slash is its own only one."""
    parts = F.split(F.trim(key, F.lit("/")), "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(key.startswith("/"), F.when(F.trim(key, F.lit("/")) == "", F.array(F.lit("/"))).otherwise(paths)).otherwise(F.array(key))


def primary_prefix(key: Column) -> Column:
    """The second to last ancestor, or the key itself."""
    up = key_ancestors(key)
    return F.when(F.size(up) > 1, F.try_element_at(up, F.lit(-2))).otherwise(key)


def starts_with_prefix(key: Column, prefix: str | Column) -> Column:
    """Literal prefix test; no sign in the prefix has a meaning of its own."""
    return F.startswith(key, F.lit(prefix) if isinstance(prefix, str) else prefix)


def field_path_filter(path: Column, wanted: str) -> Column:
    """The path itself, or one below it."""
    return (path == wanted) | F.startswith(path, F.lit(wanted + "."))


def redact_display(resource: Column, name: Column, key_hash: Column) -> Column:
    """The name, or for sensitive resources a short hash."""
    return F.when(resource.isin(*SENSITIVE), F.concat(F.lit("redacted:"), F.substring(key_hash, 1, 12))).otherwise(name)


def registry_parts(key: Column) -> Column:
    """Parts of a registry key behind its first one."""
    return F.split(F.trim(F.substring(key, F.lit(len("/registry/") + 1), F.char_length(key)), F.lit("/")), "/")


def registry_identity(key: Column, key_hash: Column, parts: Column | None = None) -> Column:
    """Struct of the Kubernetes identity that a registry key spells, null for other keys.

    Each attribute looks at several parts; where many rows are read, ``parts`` may be a column that
    holds ``registry_parts`` already.
    """
    parts = registry_parts(key) if parts is None else parts
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    first, n = part(0), F.size(parts)
    service = (first == "services") & part(1).isin("specs", "endpoints")
    custom = ~service & first.contains(".") & (n >= 2)
    resource = F.when(service, F.when(part(1) == "specs", "services").otherwise("endpoints")).when(custom, part(1)).otherwise(first)
    groups = F.create_map(*[F.lit(x) for pair in API_GROUPS.items() for x in pair])
    group = F.when(service, "").when(custom, first).otherwise(F.coalesce(F.try_element_at(groups, first), F.lit("")))
    depth = F.when(service | custom, 2).otherwise(1)
    rest = n - depth
    after = lambda i: F.when(service | custom, part(2 + i)).otherwise(part(1 + i))
    cluster = F.when(custom, rest == 1).when(service, False).otherwise(first.isin(*CLUSTER_SCOPED))
    lone = F.when(rest == 1, after(0)).otherwise("")
    namespace = F.when(custom, F.when(rest == 2, after(0)).otherwise("")).when(cluster, "").when(rest >= 1, after(0)).otherwise("")
    name = F.when(cluster, lone).when(rest == 2, after(1)).otherwise("")
    empty = first == ""
    text = lambda c: F.when(empty, "").otherwise(c)
    prefix = F.when(empty, "").otherwise(F.concat(F.lit("/registry/"), F.when(service | custom, F.concat_ws("/", first, part(1))).otherwise(first)))
    made = F.struct(
        prefix.alias("storage_prefix"),
        text(group).alias("api_group"),
        text(resource).alias("resource"),
        text(namespace).alias("namespace"),
        text(name).alias("name"),
        text(redact_display(resource, name, key_hash)).alias("display_name"),
        (~empty & custom).alias("crd"),
        (~empty & cluster).alias("cluster_scoped"),
        (~empty & resource.isin(*SENSITIVE)).alias("sensitive"),
    )
    return F.when(key.startswith("/registry/"), made)


def redact_report_key(key: Column, key_hash: Column) -> Column:
    """Key text for reports: a sensitive object's name gives way to its short hash."""
    own = registry_identity(key, key_hash)
    path = F.concat_ws("/", own["storage_prefix"], F.when(own["namespace"] != "", own["namespace"]), own["display_name"])
    return F.when(own["sensitive"] & (own["name"] != ""), path).otherwise(key)


def object_key(group: Column, resource: Column, namespace: Column, name: Column) -> Column:
    """Registry key text of an object named by an API request; null without resource or name."""
    listed = resource.isin(*API_GROUPS)
    middle = F.when(resource == "services", "services/specs").when(resource == "endpoints", "services/endpoints").when((group != "") & ~listed, F.concat_ws("/", group, resource)).otherwise(resource)
    return F.when((resource != "") & (name != ""), F.concat(F.lit("/"), F.concat_ws("/", F.lit("registry"), middle, F.when(namespace != "", namespace), name)))


def object_key_hash(group: Column, resource: Column, namespace: Column, name: Column) -> Column:
    """Struct of (hash, display_name); the hash is empty without resource or name."""
    digest = F.coalesce(F.sha2(object_key(group, resource, namespace, name), 256), F.lit(""))
    return F.struct(digest.alias("hash"), F.when(digest == "", name).otherwise(redact_display(resource, name, digest)).alias("display_name"))


_DECIMAL = "^v?[0-9]{1,9}[.][0-9]{1,9}[.][0-9]{1,9}$"


def version_family(version: Column) -> Column:
    """``3.4`` for three numeric parts of that family, else the empty text."""
    bare = F.regexp_replace(version, "^v", "")
    return F.when(version.rlike(_DECIMAL) & (bare.startswith("3.4.")), "3.4").otherwise("")


def semantic_gate(version: Column, source: Column) -> Column:
    """Whether keys may be decoded: a family from the file's metadata must be ``3.4``, any other version an exact 3.4.x."""
    return F.when(source == "database_metadata", version == "3.4").otherwise(version_family(version) == "3.4")


def compatible_versions(a: Column, b: Column) -> Column:
    """Whether the first two parts are there and equal."""
    two = lambda v: F.slice(F.split(v, "[.]"), 1, 2)
    return F.coalesce((F.size(F.split(a, "[.]")) >= 2) & (F.size(F.split(b, "[.]")) >= 2) & (two(a) == two(b)), F.lit(False))
