"""Audit requests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvspace.functions.keys import SENSITIVE, object_key_hash

# Fixed values.
WRITE_VERBS = ("create", "update", "patch", "delete", "deletecollection")
VERBS = ("get", "list", "watch", *WRITE_VERBS, "proxy", "connect")
STAGES = {"ResponseComplete": 4, "ResponseStarted": 3, "Panic": 2, "RequestReceived": 1}

_V4 = "^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"


def is_write_verb(verb: Column) -> Column:
    return F.lower(verb).isin(*WRITE_VERBS)


def is_verb(verb: Column) -> Column:
    return F.lower(verb).isin(*VERBS)


def stage_rank(stage: Column) -> Column:
    out = F.lit(0)
    for name, rank in STAGES.items():
        out = F.when(stage == name, rank).otherwise(out)
    return out


def _v6_network(ip: Column) -> Column:
    """The first 64 bits of an IPv6 address in their shortest form, with ``::/64``; null if it is none.

    The second half of a network is zero, so it always is the longest run of zeros and takes
    the double colon with the zero groups before it.
    """
    address, scope = F.substring_index(ip, "%", 1), F.substring_index(ip, "%", -1)
    scoped = ~ip.contains("%") | ((F.regexp_count(ip, F.lit("%")) == 1) & (scope != ""))
    dotted = F.contains(address, F.lit("."))
    tail = ~dotted | F.substring_index(address, ":", -1).rlike(_V4)
    even = F.when(dotted, F.regexp_replace(address, "[^:]+$", "0:0")).otherwise(address)
    short = F.contains(even, F.lit("::"))
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(even, "::", 1)), groups(F.when(short, F.substring_index(even, "::", -1)).otherwise(""))
    given = F.size(left) + F.size(right)
    shaped = F.when(short, even.rlike("^(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?$") & (given <= 7)).otherwise(even.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"))
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0))), right)
    first = F.array_join(F.transform(F.slice(whole, 1, 4), lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", "")), ":")
    return F.when(scoped & tail & shaped, F.concat(F.regexp_replace(first, "(?:^|:)0(?::0)*$", ""), F.lit("::/64")))


def mask_network(ip: Column) -> Column:
    """Struct (network, hash): the first 24 bits of an IPv4 address, 64 of an IPv6 address, else ``unknown``."""
    network = F.when(ip.rlike(_V4), F.concat(F.regexp_replace(ip, "[0-9]+$", "0"), F.lit("/24"))).when(ip.contains(":"), F.coalesce(_v6_network(ip), F.lit("unknown"))).otherwise("unknown")
    return F.struct(F.when(ip.isNull(), "").otherwise(network).alias("network"), F.coalesce(F.sha2(ip, 256), F.lit("")).alias("hash"))


def audit_normalize(event: Column, line: Column, only: tuple[str, ...] | None = None) -> Column:
    """Struct of an audit event from its parsed JSON; nothing but listed attributes, sizes and hashes.

    Object sizes are those of the JSON without spaces. ``only`` names the attributes to compute, by default all.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    version = text(event["objectRef"]["apiVersion"])
    group = F.when(version.contains("/"), F.substring_index(version, "/", 1)).otherwise("")
    resource, namespace, name = (text(event["objectRef"][n]) for n in ("resource", "namespace", "name"))
    key = object_key_hash(group, resource, namespace, name)
    source = mask_network(F.get(event["sourceIPs"], F.lit(0)))
    user, agent, audit_id = text(event["user"]["username"]), text(event["userAgent"]), text(event["auditID"])
    size = lambda n: F.coalesce(F.octet_length(F.get_json_object(line, f"$.{n}")), F.lit(0)).cast("bigint")
    values = {
        "audit_id_hash": F.when(audit_id == "", F.sha2(F.trim(line), 256)).otherwise(F.sha2(audit_id, 256)),
        "observed_at": F.coalesce(event["stageTimestamp"], event["requestReceivedTimestamp"]),
        "stage": text(event["stage"]),
        "stage_rank": stage_rank(text(event["stage"])),
        "verb": F.lower(text(event["verb"])),
        "username": F.when(user == "", "unknown").otherwise(user),
        "username_hash": F.sha2(user, 256),
        "user_agent": F.coalesce(F.get(F.split(F.trim(agent), "\\s+"), F.lit(0)), F.lit("")),
        "user_agent_hash": F.sha2(agent, 256),
        "source_network": source["network"],
        "source_ip_hash": source["hash"],
        "api_group": group,
        "resource": resource,
        "subresource": text(event["objectRef"]["subresource"]),
        "namespace": namespace,
        "object_name": F.when(resource.isin(*SENSITIVE), "").otherwise(name),
        "display_name": key["display_name"],
        "object_key_hash": key["hash"],
        "response_code": F.coalesce(event["responseStatus"]["code"], F.lit(0)),
        "request_object_bytes": size("requestObject"),
        "response_object_bytes": size("responseObject"),
        "parse_status": F.lit("parsed"),
    }
    return F.struct(*[c.alias(n) for n, c in values.items() if only is None or n in only])
