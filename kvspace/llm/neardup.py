"""Near-duplicate classes by consistent weighted sampling of TF-IDF shingles.

Shingles are five consecutive words (a text of one to four words is one shingle), told apart
by 32 bits of their hash. Their weight is term count times 1 + ln(N / max(df, floor * N)),
with df counted exactly over all documents. The floor (one document in a thousand, more only
where the mean text has over a million shingles times that) means that shingles rarer than it
weigh alike: what decides there is how often a text was copied, which is the very thing
looked for. It also bounds the table of weights, whatever the size of the corpus.

Each text gets ``bands * rows`` samples of improved consistent weighted sampling, drawn in
``PASSES`` passes over its shingles with a part of the samples each; runs of samples form
bands, texts that share a band are candidates, and candidates are verified by the weighted
Jaccard similarity of their whole shingle multisets.

Work is done for distinct texts. Candidates are first compared along stars, one leader for
each band bucket, so a bucket of m texts that belong together costs m comparisons. A text
that does not come to be in the class of one of its leaders is looked up, with all texts of
its buckets, by prefixes: shingles in order of rising frequency, where two texts of the
similarity must share one before too little weight is left. Pairs of one class are left out
there, and so are those whose remaining weights cannot reach the similarity. No link is lost.

Null texts count as empty. Texts without a word belong together only if they are equal. Very
long texts are read whole. Repeated rows and equal texts fall into one class; ties go to the
lesser text fingerprint, then the lesser doc_id. Extra columns are not read. Rows of null
doc_id take part like any other; a class whose ids are all null has a null class_id. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kvspace.llm.ranks import SALTS, attach
from kvspace.llm.store import cut, materialize, shuffled_joins, small_batches
from kvspace.llm.text import SMALL, buffers, extend, mix, slices, unused, windows, words
from kvspace.llm.urls import MAX_LISTED, build_filter, hit

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
#: Passes of the sampling; each has a bin for every sample it draws.
PASSES = 12
#: Shingles in fewer documents than this share weigh alike.
FLOOR = 0.001
#: Shingles with a weight of their own, at most; the floor rises for texts too long for it.
MAX_FREQUENT = 1 << 20
#: Shingle occurrences that a task counts at a time.
BLOCK = 1 << 22

_U = np.uint64


def _shingles(part: pa.RecordBatch, size: int = SHINGLE, prints: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(row, shingle, count) of the distinct shingles of each row, sorted; and a fingerprint of each row, if asked for."""
    w = words(part.column("text"))
    counts = w.counts()
    at, hashes = windows(w, size)
    row = np.searchsorted(w.first, at, "right") - 1
    for n in range(1, size):
        if (counts == n).any():
            a, h = windows(w, n)
            r = np.searchsorted(w.first, a, "right") - 1
            ok = counts[r] == n
            hashes, row = np.concatenate([hashes, h[ok]]), np.concatenate([row, r[ok]])
    key = (row.astype(_U) << _U(32)) | (hashes >> _U(32))
    key, count = np.unique(key, return_counts=True)
    row, shingle = (key >> _U(32)).astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.uint32)
    if not prints:
        return row, shingle, count, []
    first = np.searchsorted(row, np.arange(part.num_rows + 1))
    data, offsets = buffers(part.column("text"))
    marks = []
    for i in range(part.num_rows):
        a, b = first[i], first[i + 1]
        body = shingle[a:b].tobytes() + count[a:b].astype(np.uint32).tobytes() if b > a else b"text" + data[offsets[i] : offsets[i + 1]].tobytes()
        marks.append(hashlib.blake2b(body, digest_size=16).digest())
    return row, shingle, count, marks


@dataclass(frozen=True)
class Idf:
    """Weights of the frequent shingles (sorted), and the weight of all others."""

    shingles: np.ndarray
    weights: np.ndarray
    rest: float

    def of(self, shingle: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(shingle), self.rest)
        place = np.minimum(np.searchsorted(self.shingles, shingle), len(self.shingles) - 1)
        return np.where(self.shingles[place] == shingle, self.weights[place], self.rest)


def inverse_frequency(docs: DataFrame, floor: float = FLOOR, most: int = MAX_FREQUENT) -> Idf:
    """Exact inverse document frequencies of all shingles that reach the floor.

    A shingle of floor * N documents holds half the floor in some block of documents, so it is
    enough that each block reports those; what they report in all, with what may be missing,
    leaves at most 2 * most shingles, which are then counted exactly.
    """

    def counted(held):
        """As np.unique with counts, in 32 bits and without copies; held is emptied."""
        every = np.concatenate(held)
        held.clear()
        every.sort()
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)]).astype(np.int32)
        return every[first], np.diff(first, append=np.int32(len(every)))

    def merged(a, b):
        shingle, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
        return shingle, np.bincount(at, np.concatenate([a[1], b[1]])).astype(np.int64)

    def report(batches):
        """Blocks of BLOCK occurrences at least, if the task has as many: a rest goes to the block before it."""
        held: list[np.ndarray] = []
        last, docs_of_last, size_of_last = None, 0, 0
        n = size = 0

        def told():
            shingle, df = last
            known = df >= floor / 2 * docs_of_last
            return pa.RecordBatch.from_arrays([pa.array(np.append(shingle[known].astype(np.int64), -1)), pa.array(np.append(df[known], size_of_last))], names=["shingle", "df"])

        for batch in batches:
            for part in slices(batch, "text", SMALL):
                _, shingle, _, _ = _shingles(part, prints=False)
                held.append(shingle)
                n, size = n + part.num_rows, size + len(shingle)
                if size >= BLOCK:
                    if last is not None:
                        yield told()
                    last, docs_of_last, size_of_last = counted(held), n, size
                    held, n, size = [], 0, 0
        if n:
            rest = counted(held)
            last = rest if last is None else merged(last, rest)
            docs_of_last, size_of_last = docs_of_last + n, size_of_last + size
        if last is not None:
            yield told()

    texts = docs.select("text")
    n = texts.count()
    # blocks of few documents would report shingles that one document holds, so small partitions are read together
    grouped = cut(texts.coalesce(max(1, int(n * floor / 8))).mapInArrow(report, "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df")).filter((F.col("shingle") < 0) | (F.col("df") >= floor / 2 * n)))
    total = grouped.filter("shingle < 0").select("df").first()
    if total is None:
        return Idf(np.zeros(0, np.uint32), np.zeros(0), 1.0)
    floor_ = max(floor, total[0] / n / most)
    maybe = np.sort(grouped.filter((F.col("shingle") >= 0) & (F.col("df") >= floor_ * n - floor / 2 * n)).select("shingle").toArrow().column(0).to_numpy()).astype(np.uint32)  # 2 * most at most
    shared = docs.sparkSession.sparkContext.broadcast(maybe)

    def count(batches):
        known = shared.value
        df = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", SMALL):
                _, shingle, _, _ = _shingles(part, prints=False)
                place = np.minimum(np.searchsorted(known, shingle), len(known) - 1)
                df += np.bincount(place[known[place] == shingle], minlength=len(known))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["at", "df"])

    df = np.zeros(len(maybe), dtype=np.int64)
    if len(maybe):
        found = texts.mapInArrow(count, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
        df[found.column("at").to_numpy()] = found.column("df").to_numpy()
    reach = df >= floor_ * n
    return Idf(maybe[reach], 1 + np.log(n / df[reach]), 1 + float(np.log(n / max(1.0, floor_ * n))))


@cache
def _gamma(bits: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 in 2**bits steps, from its distribution function 1 - (1 + x) exp(-x)."""
    x = np.concatenate([np.geomspace(1e-9, 1e-3, 4000), np.linspace(1e-3, 45, 400_000)[1:]])
    p = -np.expm1(-x) - x * np.exp(-x)
    return np.interp((np.arange(1 << bits) + 0.5) / (1 << bits), p, x)


@cache
def _log_gamma(bits: int) -> np.ndarray:
    return np.log(_gamma(bits))


def _bands(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, bands: int, each: int, passes: int = PASSES) -> np.ndarray:
    """rows x bands band keys from improved consistent weighted sampling, with ``bands * each / passes`` bins a pass.

    Within a bin, a shingle is drawn with a probability in proportion to its weight. A text
    with fewer shingles than bins fills its empty bins from the others of the pass.
    """
    bins = bands * each // passes
    log_weight = np.log(weight)
    base = row * bins
    values = np.zeros((rows, passes, bins), dtype=_U)
    for k in range(passes):
        x = mix(shingle.astype(_U) + _U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        y = x * _U(0xD1342543DE82EF95)
        r = _gamma(14)[(x >> _U(50)).astype(np.int64)]
        log_c = _log_gamma(16)[((x >> _U(30)) & _U(0xFFFF)).astype(np.int64)]
        beta = (y >> _U(40)).astype(np.float64) * (1 / (1 << 24))
        step = np.floor(log_weight / r + beta)
        log_a = log_c - r * (step - beta + 1)
        cell = base + ((y >> _U(8) & _U(0xFFFFFF)) * _U(bins) >> _U(24)).astype(np.int64)
        least = np.full(rows * bins, np.inf)
        np.minimum.at(least, cell, log_a)
        won = np.flatnonzero(log_a == least[cell])
        value = np.zeros(rows * bins, dtype=_U)
        value[cell[won]] = mix(x[won] + step[won].astype(np.int64).view(_U)) | _U(1)
        values[:, k] = value.reshape(rows, bins)
    place = np.arange(bins, dtype=_U)
    full = values.copy()
    for attempt in range(1, 16 + bins):  # an empty bin borrows from a bin that a hash of its number chooses, or the next ones
        empty = np.flatnonzero(((values == 0).any(axis=2) & (full != 0).any(axis=2)).any(axis=1))
        if not len(empty):
            break
        source = (mix(place + _U(attempt << 20)) % _U(bins)).astype(np.int64) if attempt < 16 else (np.arange(bins) + attempt - 15) % bins
        own = values[empty]
        values[empty] = np.where(own == 0, full[empty][:, :, source], own)
    value = values.reshape(rows, passes * bins)
    keys = np.zeros((rows, bands), dtype=_U)
    for j in range(each):
        keys = mix(keys * _U(0x2545F4914F6CDD1D) + value[:, j::each])
    return mix(keys ^ (np.arange(1, bands + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)))


def signatures(docs: DataFrame, idf: Idf, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, bands): node is a fingerprint of the shingles; bands is empty for texts without a word."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SMALL):
                row, shingle, count, prints = _shingles(part)
                keys = _bands(row, shingle, count * shared.value.of(shingle), part.num_rows, bands, rows)
                has = np.bincount(row, minlength=part.num_rows) > 0
                at = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(keys[has].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.binary()), lists], names=["doc_id", "node", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, t.StructType([docs.schema["doc_id"], t.StructField("node", t.BinaryType()), t.StructField("bands", t.ArrayType(t.LongType()))]))


def _shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, grams) of each node in nodes (node, doc_id); grams packs sorted shingles and counts.

    Texts are not shuffled: a Bloom filter of the doc_ids, of bounded size, tells which texts
    to read again, and the join with the nodes drops the few that it lets by in vain.
    """
    keys = nodes.filter("doc_id IS NOT NULL").select(F.xxhash64("doc_id").alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(build_filter(keys, min(keys.count(), MAX_LISTED)))

    def run(batches):
        for batch in batches:
            known = batch.column("key")
            picked = batch.filter(pa.array(hit(known.fill_null(0).to_numpy(), shared.value) | np.asarray(known.is_null())))
            for part in slices(picked, "text", SMALL):
                row, shingle, count, prints = _shingles(part)
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                grams = [shingle[a:b].tobytes() + count[a:b].astype(np.uint32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(grams, pa.binary())], names=["node", "grams"])

    keyed = docs.select(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("key"), "text")
    return keyed.mapInArrow(run, "node binary, grams binary").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams"))


def _unpacked(grams: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(grams, dtype=np.uint32).reshape(2, -1)
    return both[0], both[1]


def weighted_jaccard(a: bytes, b: bytes, idf: Idf) -> float:
    """Sum of the smaller over sum of the larger weights, over all shingles of two packed sets."""
    (xs, xc), (ys, yc) = _unpacked(a), _unpacked(b)
    if not len(xs) or not len(ys):
        return float(a == b)
    wx, wy = xc * idf.of(xs), yc * idf.of(ys)
    place = np.minimum(np.searchsorted(ys, xs), len(ys) - 1)
    same = ys[place] == xs
    both = float(np.minimum(wx[same], wy[place[same]]).sum())
    return both / (float(wx.sum()) + float(wy.sum()) - both)


def _links(pairs: DataFrame, grams: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """The pairs (a, b) of the similarity or more.

    The rows of one a are dealt to parts; each part begins with the shingles of its a, once.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    salted = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    members = salted.join(grams.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "grams")
    heads = salted.select("a", "part").distinct().join(grams.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("binary").alias("b"), "grams")

    def run(batches):
        head, leader = None, b""
        for batch in batches:
            out_a, out_b = [], []
            for a, b, g in zip(*(batch.column(c) for c in ("a", "b", "grams")), strict=True):
                if not b.is_valid:
                    head, leader = a.as_py(), g.as_py()
                elif head == a.as_py() and weighted_jaccard(leader, g.as_py(), shared.value) >= similarity:
                    out_a.append(head)
                    out_b.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])

    return heads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").isNotNull()).mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): root is the least node of the component.

    Alternating large-star and small-star steps until every node but the roots has one edge, to
    its root; each step is grouped minima and joins that split the neighbours of a node, and
    every step's result is checkpointed.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 OR (up = 1 AND down > 0)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = attach(both, least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")  # u's lesser neighbours: one for each star that it is in
        now = cut(joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct())


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, floor: float = FLOOR) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (least doc_id of its class), class_size."""
    signed, named = _classes(docs, similarity, bands, rows, floor)
    return attach(signed, named, "node").select("doc_id", "class_id", "class_size")


def _classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of docs, and (node, root, class_id, class_size): root is the least node of the class."""
    with small_batches(docs.sparkSession), shuffled_joins(docs.sparkSession):
        idf = inverse_frequency(docs, floor)
        signed = materialize(signatures(docs, idf, bands, rows), "signatures")
        nodes = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "nodes")
        roots = class_roots(docs, nodes, idf, similarity)
        named = nodes.select("node", "doc_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        classes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
        return signed.select("doc_id", "node"), materialize(attach(named.select("node", "root"), classes, "root"), "classes")


def class_roots(docs: DataFrame, nodes: DataFrame, idf: Idf, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the nodes that have a link to another, from nodes (node, doc_id, bands)."""
    every = nodes.select("node", F.explode("bands").alias("band"))
    sizes = every.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(attach(every, sizes, "band"), "members")
    weights = members.groupBy("node").agg(F.sum("n").alias("weight"))
    leaders = members.join(weights, "node").groupBy("band").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    members = materialize(attach(members.select("node", "band"), leaders, "band"), "members")
    grams = materialize(_shingle_sets(docs, nodes.join(weights, "node", "left_semi").select("node", "doc_id")), "grams")
    pairs = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = components(_links(pairs, grams, idf, similarity))
    # texts that are in another class than a leader of theirs, and all texts with such a leader, and the leader
    rooted = weights.select("node").join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    led = members.select("leader", "node").distinct().join(rooted, "node")
    tops = led.filter("leader = node").select("leader", F.col("root").alias("top"))
    known = materialize(attach(led, tops, "leader").select("leader", "node", "root", (F.col("root") != F.col("top")).alias("loose")), "led")
    open_ = known.filter("loose").select("leader").distinct()
    asked = attach(known, open_, "leader").groupBy("node").agg(F.first("root").alias("root"), F.max("loose").alias("loose"))
    second = _links(prefix_pairs(grams.join(asked, "node"), idf, similarity), grams, idf, similarity)
    # the second round links classes of the first
    top = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c))
    ends = second
    for c in ("a", "b"):
        ends = ends.join(first.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    merged = components(ends.select(top("a").alias("a"), top("b").alias("b")))
    both = first.join(merged.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    alone = merged.join(first, "node", "left_anti")  # roots of first, and nodes that only the second round has linked
    return both.unionByName(alone)


def prefix_pairs(sets: DataFrame, idf: Idf, similarity: float) -> DataFrame:
    """Pairs (a, b) that may have the similarity, of sets (node, grams, root, loose): one of them loose, roots apart.

    Shingles are put in order of rising frequency among these texts. At the first shingle that
    two texts share, neither can have less weight left than the overlap they need, which is
    t / (1 + t) of their weights in sum. So a text is looked up by the shingles before which
    no more than 1 - t of its weight lies (if it is the heavier one) or (1 - t) / (1 + t) (the
    lighter one), and only among texts of a weight that what is left allows.
    """
    shared = sets.sparkSession.sparkContext.broadcast(idf)
    need = similarity / (1 + similarity)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shingle, count = _unpacked(batch.column("grams")[i].as_py())
                weight = count * shared.value.of(shingle)
                same = lambda c, i=i, n=len(shingle): batch.column(c).take(pa.array(np.full(n, i)))
                yield pa.RecordBatch.from_arrays([same("node"), same("root"), same("loose"), pa.array(shingle.view(np.int32)), pa.array(weight), pa.array(np.full(len(shingle), weight.sum()))], names=["node", "root", "loose", "shingle", "w", "total"])

    posted = materialize(sets.select("node", "root", "loose", "grams").mapInArrow(run, "node binary, root binary, loose boolean, shingle int, w double, total double"), "postings")
    counts = materialize(posted.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    later = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slack = 1 + 1e-9
    left = posted.join(counts, "shingle").withColumn("left", F.sum("w").over(later) * slack).filter(F.col("left") >= similarity * F.col("total"))
    prefix = materialize(left.select("node", "root", "loose", "shingle", "left", "total"), "prefixes")
    size = lambda c: F.floor(F.log(c) / float(np.log1p(0.05)))
    fits = F.col("left") / need - F.col("total")  # the heaviest partner that what is left allows
    own = prefix.select(F.col("node").alias("y"), F.col("root").alias("y_root"), F.col("loose").alias("y_loose"), "shingle", F.col("left").alias("y_left"), F.col("total").alias("y_total"), size(F.col("total")).alias("bin"))
    short = F.col("left") >= 2 * need * F.col("total")
    found = []
    for heavier in (True, False):
        low, high = (similarity * F.col("total") / slack, F.least(F.col("total"), fits)) if heavier else (F.col("total"), F.least(F.col("total") / similarity * slack, fits))
        asks = prefix.filter(F.col("loose") & (F.lit(True) if heavier else short)).select("node", "root", "shingle", "left", "total", low.alias("low"), (high * slack).alias("high")).filter("high >= low")
        asks = asks.withColumn("bin", F.explode(F.sequence(size(F.col("low")), size(F.col("high")))))
        told = own.filter(F.col("y_left") >= 2 * need * F.col("y_total")) if heavier else own.filter(~F.col("y_loose"))
        apart = (F.col("root") != F.col("y_root")) & F.col("y_total").between(F.col("low"), F.col("high")) & (F.least("left", "y_left") >= need * (F.col("total") + F.col("y_total")))
        found.append(asks.join(told, ["shingle", "bin"]).filter(apart).select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b")))
    return found[0].unionByName(found[1]).distinct()


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class: that of least doc_id; of repeated rows of that doc_id, one.

    Of a class whose ids are all null, one row of the least node stays.
    """
    signed, named = _classes(docs, **options)
    kept = attach(signed, named, "node").filter(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    number, node = unused(docs, "number"), unused(docs, "node")
    one = lambda df, key: df.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy("text"))).filter(F.col(number) == 1).select(*docs.columns)
    nameless = extend(docs.filter("doc_id IS NULL"), "text", [t.StructField(node, t.BinaryType())], lambda part: [pa.array(_shingles(part)[3], pa.binary())], most=SMALL)
    alone = named.filter("class_id IS NULL AND node = root").select(F.col("node").alias(node))
    return one(docs.join(kept, "doc_id", "left_semi"), "doc_id").unionByName(one(nameless.join(alone, node, "left_semi"), node))
