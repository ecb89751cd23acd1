"""Target-distribution importance resampling.

Documents are drawn as a target set's words make likely: hashed counts of word runs give each
bucket of features a gain (how much likelier the target has it than the corpus), a document's
weight is the sum of its features' gains, and the highest weights plus Gumbel noise are drawn
without replacement. A table of 256 bytes lower-cases A-Z and blanks all separators in UTF-8,
``bytes.split`` yields the words, a run's hash is the crc32 of its next word seeded with the
hash of the run before, and Counters reduce the hashes before Spark sums them.

Null texts have no words, weigh 0 and are never drawn; a null key has the noise of an empty
one. Very long texts are read whole, in blocks. Repeated keys are scored one by one, and rows
that tie in score and key get some order of their own. An empty corpus gives an empty result,
an empty target gains from its absent features alone. Columns that have the name of an added
one are replaced, others kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kvspace.llm.ranks import number_all
from kvspace.llm.text import extend, unused

BUCKETS, LONGEST_RUN = 10_000, 1
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
#: Bytes of a text that are split at a time.
BLOCK = 1 << 20

_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def runs(raw: bytes, longest: int = LONGEST_RUN) -> Iterator[tuple[int, list[int]]]:
    """(words, hashes of the runs of 1 to ``longest`` words that end there) of each block of a text."""
    plain = raw.translate(_PLAIN)
    before: list[bytes] = []
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + BLOCK)
        end = len(plain) if end < 0 else end
        new = plain[at:end].split()
        words = before + new
        hashes = [crc32(w) for w in words]
        found = hashes[len(before) :]
        for k in range(2, longest + 1):
            hashes = [crc32(b" " + w, h) for h, w in zip(hashes, words[k - 1 :], strict=False)]
            found += hashes[max(0, len(before) - k + 1) :]
        yield len(new), found
        before = words[len(words) - longest + 1 :] if longest > 1 else []
        at = end


def _raw(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends a row for each bucket at most."""

    def run(batches):
        counted: Counter[int] = Counter()
        for batch in batches:
            for value in batch.column(0):
                for _, hashes in runs(_raw(value), longest):
                    counted.update(hashes)
            if len(counted) > 100 * buckets:
                counted = _by_bucket(counted, buckets)
        counted = _by_bucket(counted, buckets)
        yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.int64()), pa.array(list(counted.values()), pa.int64())], names=["bucket", "n"])

    return df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _by_bucket(counted: Counter[int], buckets: int) -> Counter[int]:
    out: Counter[int] = Counter()
    for h, n in counted.items():
        out[h % buckets] += n
    return out


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(bucket, gain) for each bucket: a thousand times the logarithm of the smoothed ratio of shares, rounded down."""
    own = bucket_counts(docs, text, buckets, longest).withColumnRenamed("n", "s")
    aim = bucket_counts(target, text, buckets, longest).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(own, "bucket", "left").join(aim, "bucket", "left").na.fill(0, ["s", "t"])
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    d = lambda c, more: F.col(c).cast("double") + more
    ratio = d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a key in thousandths, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def score(docs: DataFrame, gained: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """docs with n_words, n_features, weight and score.

    ``gained`` has a row for each bucket, so its number is a parameter; it goes to the tasks whole.
    """
    gain = [r["gain"] for r in gained.orderBy("bucket").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    drawn = unused(docs, "_noise")

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        gain = shared.value
        buckets = len(gain)
        words, features, weights = [], [], []
        for value in part.column(text):
            n_words = n_features = weight = 0
            for n, hashes in runs(_raw(value), longest):
                n_words += n
                n_features += len(hashes)
                weight += sum(gain[h % buckets] * c for h, c in Counter(hashes).items())
            words.append(n_words)
            features.append(n_features)
            weights.append(weight)
        noises = part.column(drawn).to_pylist()
        return [pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(weights, pa.int64()), pa.array([w + z for w, z in zip(weights, noises, strict=True)], pa.int64())]

    fields = [t.StructField(n, t.LongType()) for n in ("n_words", "n_features", "weight", "score")]
    return extend(docs.withColumn(drawn, noise(F.col(key), seed)), text, fields, make).drop(drawn)


def draw(scored: DataFrame, key: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored with rank: 1, 2, .. of the drawn documents, null for the others.

    ``percent`` of the documents of ``min_words`` or more are drawn, the highest scores first,
    ties in the order of the key.
    """
    fit = F.col("n_words") >= min_words
    numbered = number_all(scored, [fit.desc(), F.col("score").desc(), F.col(key).asc_nulls_last()], "rank")
    size = numbered.agg(F.coalesce(F.sum(fit.cast("long")), F.lit(0)).alias("n")).first()["n"] * percent // 100
    return numbered.withColumn("rank", F.when(fit & (F.col("rank") <= size), F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, longest: int = LONGEST_RUN) -> DataFrame:
    """The drawn documents with all their columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    scored = score(packed, gains(docs, target, text, longest=longest), "key", "text", longest).drop("text")
    return draw(scored, "key", percent).filter(F.col("rank").isNotNull()).select("row.*")


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank."""
    scored = score(docs.select("doc_id", "text"), gains(docs, target)).drop("text")
    return draw(scored).select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")
