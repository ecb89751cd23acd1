"""Stored values: their format, and statistics of their JSON fields that hold no content."""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kvspace.schemas import FIELDS

MAX_VALUE = 32 << 20
MORE_FIELDS, MAX_DEPTH, MAX_NODES = 20, 128, 50_000

# Paths that are always reported, and those whose inside is not.
SELECTED = (
    "metadata.managedFields", "metadata.annotations", "metadata.labels", "metadata.creationTimestamp", "metadata.deletionTimestamp",
    "spec", "spec.renewTime", "status", "status.heartbeatTime", "lastTimestamp", "eventTime", "data", "binaryData",
)
OPAQUE = frozenset({"metadata.managedFields", "metadata.annotations", "metadata.labels", "data", "binaryData"})
PROTOBUF = b"k8s\x00"


def classify_value(value: Column, identity: Column) -> Column:
    """Struct (content_type, decode_status) of a binary value; null for keys outside the registry.

    Protobuf bodies are not decoded; they keep the status of an unsupported kind.
    """
    text = F.when(F.is_valid_utf8(value.cast("string")), value.cast("string"))
    parsed = F.try_parse_json(text)
    both = lambda kind, status: F.struct(F.lit(kind).alias("content_type"), F.lit(status).alias("decode_status"))
    is_object = F.trim(text).startswith("{")
    return F.when(
        identity.isNotNull(),
        F.when(F.octet_length(value) > MAX_VALUE, both("oversized", "oversized"))
        .when((identity["resource"] == "") | (identity["name"] == ""), both("unknown", "path_unknown"))
        .when(F.startswith(value, F.lit(b"k8s:enc:")), both("encrypted", "encrypted"))
        .when(parsed.isNotNull() & is_object, both("json", "decoded_json"))
        .when(parsed.isNotNull(), both("json", "decode_failed"))
        .when(F.startswith(value, F.lit(PROTOBUF)), both("protobuf", "protobuf_unsupported"))
        .otherwise(both("unknown", "format_unknown")),
    )


def _number(x: float) -> str:
    """A double as encoding/json prints it: shortest digits, an exponent below 1e-6 and from 1e21 on."""
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    digits = repr(abs(x))
    mantissa, _, exponent = digits.partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    point = len(whole) + int(exponent or 0)
    figures = (whole + fraction).lstrip("0")
    point -= len(whole + fraction) - len(figures) if whole.strip("0") == "" else 0
    figures = figures.rstrip("0") or "0"
    sign = "-" if x < 0 else ""
    if 1e-6 <= abs(x) < 1e21:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{figures}"
        if point >= len(figures):
            return sign + figures + "0" * (point - len(figures))
        return f"{sign}{figures[:point]}.{figures[point:]}"
    e = point - 1
    rest = f".{figures[1:]}" if len(figures) > 1 else ""
    return f"{sign}{figures[0]}{rest}e{'-' if e < 0 else '+'}{abs(e):02d}"


_ESCAPES = str.maketrans({"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"})
_ODD = re.compile("[<>&  \b\f]")


def _string(value: str) -> bytes:
    out = encode_basestring(value)
    if _ODD.search(value):
        out = out.replace("\\b", "\\u0008").replace("\\f", "\\u000c").translate(_ESCAPES)
    return out.encode("utf-8", "replace")


@lru_cache(maxsize=1 << 14)
def _key(key: str) -> tuple[bytes, bytes]:
    """(bytes that keys are ordered by, the key as JSON)."""
    return key.encode("utf-8", "surrogatepass"), _string(key)


def _joined(parts: dict[str, bytes]) -> bytes:
    """A JSON object of members that are JSON already."""
    members = [(*_key(k), data) for k, data in parts.items()]
    members.sort()
    return b"{" + b",".join([name + b":" + data for _, name, data in members]) + b"}"


def canonical(value) -> bytes:
    """JSON with sorted keys, doubles for all numbers, and the signs of markup escaped."""
    if isinstance(value, str):
        return _string(value)
    if isinstance(value, dict):
        return _joined({k: canonical(v) for k, v in value.items()})
    if isinstance(value, list):
        return b"[" + b",".join(map(canonical, value)) + b"]"
    if value is None or isinstance(value, bool):
        return {None: b"null", True: b"true", False: b"false"}[value]
    if isinstance(value, int) and abs(value) < 1 << 53:
        return str(value).encode()
    x = float(value)
    if math.isinf(x):
        raise OverflowError("number out of range")
    return _number(x).encode()


_CLASSES = {type(None): "null", dict: "object", list: "array", bool: "boolean", str: "string"}


def type_class(value) -> str:
    return _CLASSES.get(type(value), "number")


def _within_limits(root) -> bool:
    nodes, stack = 0, [(root, 0)]
    while stack:
        value, depth = stack.pop()
        nodes += 1
        if nodes > MAX_NODES or depth > MAX_DEPTH:
            return False
        if isinstance(value, dict):
            stack += [(v, depth + 1) for v in value.values()]
        elif isinstance(value, list):
            stack += [(v, depth + 1) for v in value]
    return True


_decode = json.JSONDecoder(parse_constant=lambda _: 1 / 0).decode
_selected = frozenset(SELECTED)


def _record(found: dict[str, tuple], path: str, value, data: bytes) -> None:
    if path not in found or len(data) > len(found[path][2]):  # keys with dots may spell one path twice
        found[path] = (path, type_class(value), data)


def _walk(value: dict, path: str, found: dict[str, tuple]) -> bytes:
    """The object as JSON, made once from its members'; records what is below it under its path."""
    parts = {}
    for k, v in value.items():
        own = f"{path}.{k}" if path else k
        parts[k] = data = _walk(v, own, found) if isinstance(v, dict) and own not in OPAQUE else canonical(v)
        if own and own != "metadata":
            _record(found, own, v, data)
    return _joined(parts)


def object_fields(text: str | None) -> tuple[str, list[tuple[str, int, str, str]]]:
    """(decode status, fields) of JSON text: the selected paths, then the largest others."""
    try:
        root = _decode(text or "")
    except (ValueError, ZeroDivisionError, RecursionError):
        return "decode_failed", []
    if not isinstance(root, dict):
        return "decode_failed", []
    if not _within_limits(root):
        return "field_limit_exceeded", []

    found: dict[str, tuple] = {}
    try:
        _walk(root, "", found)
    except OverflowError:
        return "decode_failed", []
    others = [f for p, f in found.items() if p not in _selected]
    others.sort(key=lambda f: (-len(f[2]), f[0]))
    kept = [found[p] for p in SELECTED if p in found] + others[:MORE_FIELDS]
    return "decoded_json", [(p, len(data), kind, sha256(data).hexdigest()) for p, kind, data in kept]


def field_stats(text: Column) -> Column:
    """Struct (status, fields) of JSON text, in Arrow batches: the tree walk has no built-in form of any depth."""

    @F.arrow_udf(f"struct<status:string,fields:{FIELDS}>")
    def run(values: pa.Array) -> pa.Array:
        found = [object_fields(v) for v in values.to_pylist()]
        flat = [f for _, fields in found for f in fields]
        columns = zip(*flat, strict=True) if flat else [[]] * 4
        field = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "byte_size", "type_class", "hash"])
        ends = pa.array([0, *accumulate(len(fields) for _, fields in found)], pa.int32())
        return pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.ListArray.from_arrays(ends, field)], names=["status", "fields"])

    return run(text)
