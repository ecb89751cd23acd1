"""URL filters: rules, and a list of canonical URLs behind a blocked Bloom filter.

Most URLs are on no list. A blocked Bloom filter of the list (each URL sets bits in one
512-bit block) lets them pass at once; only possible hits go to an exact join with the list,
which removes the filter's false positives. The filter's size is bounded: a longer list is
dealt by hash into parts, each with a filter of its own.

A null url, or one without ``://``, has an empty host and path, fits no rule, and is not
listed. URLs of any length are read whole. Of two rules of equal length that both fit, the
later of the list decides. Repeated rows are judged one by one. An empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kvspace.llm.store import materialize

#: Listed URLs of one filter: 2 bytes each, 32 MB at most.
MAX_LISTED = 16_000_000
_BITS_EACH, _BLOCK, _PROBES = 16, 512, 8
#: Values that the join keys of passed rows are spread over.
PASSED = 1 << 20

#: (verdict, host, path): the rules of the registered query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host + path: without scheme, user, default port, query, fragment, a last slash or a leading www; null for no URL."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), "^[^@]*@", ""), ":(80|443)$", ""), "^www\\.", "")
    return F.when(host_of(url) != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", "")))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, or nulls."""
    text = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest comes to stand first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text if text is not None else F.lit(None).cast("string"))
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict if verdict is not None else F.lit(None).cast("string"))
    return text, verdict


def _places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits) of 64-bit keys: the high half chooses the block, the low half steps through its bits."""
    key = keys.view(np.uint64)
    block = ((key >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = key & np.uint64(0xFFFFFFFF)
    step = (low * np.uint64(0x9E3779B1) >> np.uint64(7)) | np.uint64(1)
    bits = (low[:, None] + np.arange(_PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(_BLOCK)
    return block.astype(np.int64), bits.astype(np.int64)


def build_filter(listed: DataFrame, n: int) -> np.ndarray:
    """Bits of the filter for the n values of ``key``; at most 2 bytes a value.

    Tasks make (word, mask) pairs, Spark joins masks of the same word with a bitwise or.
    """
    blocks = max(1, -(-n * _BITS_EACH // _BLOCK))

    @F.pandas_udf("array<struct<word:long,mask:long>>")
    def bits(keys: pd.Series) -> pd.Series:
        block, bit = _places(keys.to_numpy(dtype=np.int64), blocks)
        word = block[:, None] * (_BLOCK // 64) + bit // 64
        mask = (np.uint64(1) << (bit % 64).astype(np.uint64)).view(np.int64)
        return pd.Series([[{"word": int(w), "mask": int(m)} for w, m in zip(ws, ms, strict=True)] for ws, ms in zip(word, mask, strict=True)])

    words = listed.select(F.inline(bits("key"))).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(blocks * (_BLOCK // 64), dtype=np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["mask"]
    return out


def hit(keys: np.ndarray, filter_words: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each 64-bit key."""
    block, bit = _places(np.ascontiguousarray(keys, dtype=np.int64), len(filter_words) // (_BLOCK // 64))
    word = filter_words[block[:, None] * (_BLOCK // 64) + bit // 64].view(np.uint64)
    return ((word >> (bit % 64).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def maybe_listed(key: Column, filter_words: np.ndarray, spark) -> Column:
    shared = spark.sparkContext.broadcast(filter_words)

    @F.pandas_udf(t.BooleanType())
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(hit(keys.to_numpy(dtype=np.int64), shared.value))

    # a batch with nulls would reach pandas as doubles, which cannot hold 64-bit keys
    return key.isNotNull() & test(F.coalesce(key, F.lit(0).cast("long")))


def listed_flag(pages: DataFrame, listed: DataFrame, max_listed: int = MAX_LISTED) -> DataFrame:
    """pages (with ``canonical``) and a boolean ``listed``; ``listed`` has distinct values of ``canonical``."""
    spark = pages.sparkSession
    listed = materialize(listed.select("canonical", F.xxhash64("canonical").alias("key")), "listed")
    n = listed.count()
    parts = max(1, -(-n // max_listed))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(parts))
    keyed = pages.withColumn("_key", F.when(F.col("canonical").isNotNull(), F.xxhash64("canonical")))
    done = []
    for k in range(parts):
        own, mine = (keyed, listed) if parts == 1 else (keyed.filter(part("_key") == k if k else (part("_key") == 0) | F.col("_key").isNull()), listed.filter(part("key") == k))
        words = build_filter(mine, min(n, 2 * max_listed))
        # one left join for hits and passed rows; these get keys that no canonical URL has (a question mark), spread so that they do not meet in one task
        passed = F.concat(F.lit("?"), F.pmod(F.coalesce("_key", F.monotonically_increasing_id()), F.lit(PASSED)).cast("string"))
        tested = own.withColumn("_asked", F.when(maybe_listed(F.col("_key"), words, spark), F.col("canonical")).otherwise(passed)).drop("_key")
        known = mine.select(F.col("canonical").alias("_asked"), F.lit(True).alias("listed"))
        done.append(tested.join(known, "_asked", "left").drop("_asked").withColumn("listed", F.coalesce("listed", F.lit(False))))
    return functools.reduce(DataFrame.unionByName, done)


def recrawled(pages: DataFrame) -> DataFrame:
    """Canonical URLs that several pages have: traps and pages that were fetched again."""
    return pages.filter(F.col("canonical").isNotNull()).groupBy("canonical").agg(F.count("*").alias("n")).filter("n > 1").select("canonical")


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed. A rule decides; without one, listed URLs are blocked.

    ``listed`` (canonical) defaults to the URLs that the pages themselves show as fetched again.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    flagged = listed_flag(named, recrawled(named) if listed is None else listed.select("canonical").distinct())
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return flagged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
