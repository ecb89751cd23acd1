"""Shards by jump consistent hashing.

The shard of a row depends on its key and the number of shards alone; adding a shard moves
about 1/(n+1) of the keys, all of them into the new shard. Integer keys are used as they
are, other keys by their 64-bit hash; a null key counts as 0. Repeated keys share a shard,
and rows that tie in all columns get slots of their own in some order. Texts of any length are
read whole for their checksums. An empty table gives an empty result. Columns named shard,
grown_shard or slot are replaced, others kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kvspace.llm.ranks import number_within

SHARDS = 40


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: jumps b -> floor((b + 1) * 2**31 / r) until beyond the last shard."""
    key = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    step = np.zeros(len(key), dtype=np.int64)
    while len(live):
        shard[live] = step[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step[live] = ((step[live] + 1) * ((1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[step[live] < shards]
    return shard


def shard_of(key: Column, shards: int, integer: bool = True) -> Column:
    @F.pandas_udf(t.IntegerType())
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return run(F.coalesce(key.cast("long"), F.lit(0).cast("long")) if integer else F.xxhash64(key))


def assign(df: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """df with shard, grown_shard (with one shard more) and slot (0, 1, .. within the shard)."""
    integer = isinstance(df.schema[key].dataType, (t.LongType, t.IntegerType, t.ShortType, t.ByteType))
    kept = df.drop("shard", "grown_shard", "slot")
    dealt = kept.withColumns({"shard": shard_of(F.col(key), shards, integer), "grown_shard": shard_of(F.col(key), shards + 1, integer)})
    order = [key, *[c for c in kept.columns if c != key and not isinstance(kept.schema[c].dataType, (t.MapType, t.VariantType))]]
    return number_within(dealt, "shard", order, "slot")


def manifest(df: DataFrame) -> DataFrame:
    """Documents, with size, text checksum and place."""
    sized = df.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return assign(sized, "doc_id").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
