"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Null and word-less texts have no windows and are clean; a null item_id is the item "null".
Very long texts are scanned whole. Items with equal windows are all told. Repeated rows are
scanned one by one. Without a benchmark all documents are clean; an empty table gives an
empty result. Documents keep all their columns; only ``find`` replaces a column that has the
name it is asked to add.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kvspace.llm.store import materialize
from kvspace.llm.text import count_before, extend, unused, windows, words

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Window rows broadcast at once (about 150 bytes each); a larger benchmark goes in blocks.
MAX_WINDOWS = 400_000
_BITS = 20

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPAN = t.ArrayType(t.StructType([t.StructField(n, t.LongType()) for n in ("first", "last", "start", "end")]))
_FOUND = t.StructType([t.StructField("n_words", t.LongType()), t.StructField("hits", _SPAN), t.StructField("items", t.ArrayType(t.StringType()))])


def _normal(raw: bytes) -> bytes:
    return b" ".join(_WORD.findall(raw.translate(_LOWER)))


def benchmark_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(h, n, words, item) of every distinct window of every item."""

    def run(batches):
        for batch in batches:
            w = words(batch.column("text"))
            counts = w.counts()
            for size in sorted({min(n, c) for c in counts.tolist()} - {0}):
                at, hashes = windows(w, size)
                row = np.searchsorted(w.first, at, "right") - 1
                ok = (counts[row] == size) | (size == n)
                at, hashes, row = at[ok], hashes[ok], row[ok]
                text = [_normal(w.data[w.starts[k] : w.ends[k + size - 1]].tobytes()) for k in at]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array(text, pa.binary()), batch.column("item").take(pa.array(row))], names=["h", "n", "words", "item"])

    rows = benchmark.select(F.col("text"), F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"))
    return rows.mapInArrow(run, "h long, n int, words binary, item string").distinct()


def _scan(docs: DataFrame, table: dict, previous: str | None, prefix: str) -> DataFrame:
    """One pass over docs against one block of windows."""
    sizes = sorted({n for n, _ in table})
    keys = {n: np.sort(np.array([h for m, h in table if m == n], dtype=np.int64).view(np.uint64)) for n in sizes}
    shared = docs.sparkSession.sparkContext.broadcast((table, keys))

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        table, keys = shared.value
        w = words(part.column("text"))
        total, rows = len(w.hashes), part.num_rows
        cover = np.zeros(total + 1, dtype=np.int64)
        items: dict[int, set[str]] = {}
        seen: dict[tuple, tuple[str, ...]] = {}
        for n, known in keys.items():
            at, hashes = windows(w, n)
            maybe = np.zeros(1 << _BITS, dtype=bool)
            maybe[(known >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            near = np.flatnonzero(maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
            if not len(near):
                continue
            place = np.minimum(np.searchsorted(known, hashes[near]), len(known) - 1)
            near = near[known[place] == hashes[near]]
            for k, h in zip(at[near].tolist(), hashes[near].view(np.int64).tolist(), strict=True):
                raw = w.data[w.starts[k] : w.ends[k + n - 1]].tobytes()
                if (found := seen.get((n, raw))) is None:
                    found = seen[n, raw] = table[n, h].get(_normal(raw), ())
                if found:
                    cover[k] += 1
                    cover[k + n] -= 1
                    items.setdefault(int(np.searchsorted(w.first, k, "right")) - 1, set()).update(found)
        hit = np.cumsum(cover[:-1]) > 0
        before = part.column(previous).to_pylist() if previous else [None] * rows
        spans, found = [], []
        for i in range(rows):
            own: set[str] = items.get(i, set())
            a, b = int(w.first[i]), int(w.first[i + 1])
            old = before[i]
            if old and old["hits"]:
                for s in old["hits"]:
                    hit[a + s["first"] : a + s["last"] + 1] = True
                own = own | set(old["items"])
            out = []
            if own:
                edge = np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]]))
                firsts, lasts = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
                base = int(w.starts[a])
                lead = _row_start(part, i)
                skip = int(count_before(w.data, lead, np.array([base]))[0])
                begin, end = skip + count_before(w.data, base, w.starts[a + firsts]), skip + count_before(w.data, base, w.ends[a + lasts])
                out = [dict(zip(("first", "last", "start", "end"), map(int, x), strict=True)) for x in zip(firsts, lasts, begin, end, strict=True)]
            spans.append(out)
            found.append(sorted(own))
        made = pa.StructArray.from_arrays([pa.array(w.counts()), pa.array(spans, _ARROW_SPAN), pa.array(found, pa.list_(pa.string()))], names=["n_words", "hits", "items"])
        return [made]

    return extend(docs, "text", [t.StructField(prefix, _FOUND)], make)


_ARROW_SPAN = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))


def _row_start(part: pa.RecordBatch, i: int) -> int:
    from kvspace.llm.text import buffers

    return int(buffers(part.column("text"))[1][i])


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, max_windows: int = MAX_WINDOWS, column: str = "found") -> DataFrame:
    """docs with a struct ``column``: n_words, hits (runs of hit words with code-point spans), items.

    The windows are counted before they are broadcast; beyond ``max_windows`` rows they are
    dealt by hash into blocks of about that many, and the documents are scanned once for
    each block, with the hits merged by position.
    """
    table = materialize(benchmark_windows(benchmark, n), "windows")
    rows = table.count()
    blocks = max(1, -(-rows // max_windows))
    out, previous = docs, None
    for b in range(blocks):
        block = table if blocks == 1 else table.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b)
        held: dict[tuple[int, int], dict[bytes, tuple[str, ...]]] = {}
        for r in block.toLocalIterator():
            own = held.setdefault((r["n"], r["h"]), {})
            own[bytes(r["words"])] = (*own.get(bytes(r["words"]), ()), r["item"])
        name = column if b == blocks - 1 else f"{column}_{b}"
        out = _scan(out, held, previous, name)
        if previous:
            out = out.drop(previous)
        if b < blocks - 1:
            out, previous = materialize(out, "decontam"), name
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans."""
    found = find(docs.select("doc_id", "text"), benchmark).drop("text")
    n_hit = F.aggregate("found.hits", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.transform("found.hits", lambda s: F.concat_ws(":", s["start"], s["end"])).alias("hit_spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (mode "spans") with the hit spans cut out.

    A cut span leaves one line break, so that the words around it do not join.
    """
    name = unused(docs, "found")
    found = find(docs, benchmark, column=name)
    if mode == "documents":
        return found.filter(F.size(f"{name}.hits") == 0).select(*docs.columns)
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode}")
    text = F.col("text")
    cuts = F.transform(F.col(f"{name}.hits"), lambda s: F.struct(s["start"].cast("int").alias("a"), s["end"].cast("int").alias("b")))
    begun = F.aggregate(
        cuts,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["a"] - acc["at"]), F.lit("\n")).alias("out"), s["b"].alias("at")),
    )
    rest = F.concat(begun["out"], F.substring(text, begun["at"] + 1, F.char_length(text)))
    return found.withColumn("text", F.when(F.size(cuts) > 0, rest).otherwise(text)).select(*docs.columns)
