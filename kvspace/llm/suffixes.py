"""Removal of long repeats by a logarithmic family of suffix arrays.

A byte is removed if a string of WIDTH bytes that covers it also starts in a document with a
smaller key; strings are judged on the input, and matches never cross documents.

The suffixes that are sorted are those at anchors: of the runs of GRAM bytes within a window
of WIDTH bytes, the one of least hash (the leftmost of equal ones) is the window's anchor, so
equal windows have equal anchors wherever they stand. A *piece* holds all windows of a stretch
that share an anchor, and is sorted by the suffix at it. A first pass exchanges 40-bit hashes of
the anchors, one for each slice of the corpus that has it, and finds the anchors that stand
more than once; only their pieces are exchanged. Each slice is a new batch with a suffix array
of its own, scanned against itself; in a bucket of anchors, batches are merge-scanned
against the levels that are there, and levels of about equal size merge geometrically. Where
two arrays share an anchor, the windows of its pieces are sorted by all their bytes, and all but
those of the least key are hits. Pieces of which all windows are hit leave the family: their
least occurrence stands for them. So a passage that a third of all documents share reaches
its bucket once for each slice, and no order of arrival matters.

Keys are integers; a null key counts as the largest, and documents of equal keys (repeated
rows) don't repeat each other. Null texts count as empty; texts of any length are read whole,
each in one task, and may be slices of their own. An empty table gives an empty result. Columns
that have the name of an added one are replaced, others kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kvspace.llm.store import materialize
from kvspace.llm.text import CHUNK, buffers, mix, slices, unused

#: Bytes of a match, and of an anchor.
WIDTH, GRAM = 50, 24
#: Bytes of text whose anchors share a bucket, and partitions that buckets are dealt to at most.
BUCKET_BYTES, MAX_PARTS = 12 << 20, 20_000
#: Pieces of a batch in a bucket, and windows that are sorted at a time.
BATCH, SORTED = 50_000, 1_000_000
_LOW = np.uint64((1 << 40) - 1)
_LAST = (1 << 63) - 1
_PIECES, _HITS, _ALIASES = 0, 1, 2


def _squeeze(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays))


def _expand(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(types))
    ends = 8 * len(types) + np.cumsum(sizes)
    return [np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, e - n) for kind, n, e in zip(types, sizes.tolist(), ends.tolist(), strict=True)]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. (size[0] of them), begin[1], .."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


def anchored(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor, anchor's hash) of each piece; data's rows begin at ``at``."""
    span = width - GRAM + 1
    found = []
    ends = at[1:]
    for c in range(0, max(len(data) - width + 1, 0), CHUNK):
        n = min(CHUNK, len(data) - width + 1 - c)  # windows that begin in this chunk
        seg = np.ascontiguousarray(data[c : c + n + width - 1])
        m = len(seg) - GRAM + 1
        word = lambda k: np.ndarray((m,), "<u8", buffer=seg, offset=k, strides=(1,))
        h = mix(word(0) * np.uint64(0x9E3779B97F4A7C15))
        h = mix((h + word(8)) * np.uint64(0xC4CEB9FE1A85EC53))
        h = mix((h + word(16)) * np.uint64(0xD1B54A32D192ED03))
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: len(least) - span + size], least[span - size :])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        outside = np.zeros(n + 1, dtype=np.int32)  # windows that cross the end of a row
        near = ends[np.searchsorted(ends, c, "right") : np.searchsorted(ends, c + n + width, "left") + 1]
        np.add.at(outside, np.clip(near - width + 1 - c, 0, n), 1)
        np.add.at(outside, np.clip(near - c, 0, n), -1)
        valid = np.cumsum(outside[:-1]) == 0
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])]))
        count = np.diff(np.append(first, n))
        first, count = first[valid[first]], count[valid[first]]
        found.append((first + c, count, anchor[first] + c, h[anchor[first]]))
    if not found:
        return (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Suffixes:
    """A suffix array: pieces in the order of their anchored suffixes."""

    text: np.ndarray
    gram: np.ndarray  # the first GRAM bytes of the suffix
    at: np.ndarray  # the piece in text
    n: np.ndarray  # its windows
    doc: np.ndarray  # its document's key
    home: np.ndarray  # its slice
    pos: np.ndarray  # its first window there

    def __len__(self) -> int:
        return len(self.at)

    def take(self, chosen: np.ndarray) -> Suffixes:
        return Suffixes(self.text, *[getattr(self, f.name)[chosen] for f in fields(self)[1:]])


def suffix_array(text: np.ndarray, at, anchor, n, doc, home, pos) -> Suffixes:
    grams = np.lib.stride_tricks.sliding_window_view(text, GRAM)[anchor] if len(anchor) else np.zeros((0, GRAM), np.uint8)
    gram = np.ascontiguousarray(grams).view(f"S{GRAM}").ravel()
    return Suffixes(text, gram, at, n, doc, home, pos).take(np.argsort(gram, kind="stable"))


def merged(parts: list[Suffixes], width: int) -> Suffixes:
    """One suffix array of several; the sort finds their sorted runs. Text that no piece needs is left out."""
    texts, starts, begun = [], [], 0
    for p in parts:
        size = p.n + width - 1
        texts.append(p.text[_ranges(p.at, size)])
        starts.append(begun + np.cumsum(size) - size)
        begun += int(size.sum())
    joined = [np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Suffixes)[3:]]
    gram = np.concatenate([p.gram for p in parts])
    return Suffixes(np.concatenate(texts), gram, np.concatenate(starts), *joined).take(np.argsort(gram, kind="stable"))


def _blocks(s: Suffixes) -> Iterator[np.ndarray]:
    """Bounds of stretches of about SORTED windows that end where the gram changes."""
    if not len(s):
        return
    edge = np.append(np.flatnonzero(np.concatenate([[True], s.gram[1:] != s.gram[:-1]])), len(s))
    windows = np.concatenate([[0], np.cumsum(s.n)])[edge]
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(windows, windows[i] + SORTED, "right")) - 1)
        yield np.arange(edge[i], edge[j])
        i = j


def scan(s: Suffixes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """([slices, first windows, counts] of runs of hits, which pieces are hit whole) of pieces that share anchors."""
    whole = np.zeros(len(s), dtype=bool)
    runs: list[tuple] = []
    for block in _blocks(s):
        p = s.take(block)
        idx = _ranges(p.at, p.n)
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(s.text, width)[idx]).view(f"S{width}").ravel()
        owner = np.repeat(np.arange(len(p)), p.n)
        order = np.argsort(windows, kind="stable")
        ranked = windows[order]
        group = np.cumsum(np.concatenate([[True], ranked[1:] != ranked[:-1]])) - 1
        doc = p.doc[owner]
        least = np.minimum.reduceat(doc[order], np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])))
        hit = np.empty(len(windows), dtype=bool)
        hit[order] = doc[order] > least[group]
        before = np.cumsum(p.n) - p.n
        whole[block] = np.add.reduceat(hit, before) == p.n
        begin = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (owner[1:] != owner[:-1])]))
        end = np.flatnonzero(hit & np.concatenate([~hit[1:] | (owner[1:] != owner[:-1]), [True]]))
        runs.append((p.home[owner[begin]], p.pos[owner[begin]] + begin - before[owner[begin]], end - begin + 1))
    return ([np.concatenate(x) for x in zip(*runs, strict=True)] if runs else [np.zeros(0, np.int64)] * 3), whole


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b; both sorted."""
    if not len(b):
        return np.zeros(len(a), dtype=bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


class Family:
    """Suffix arrays of sizes that fall at least by half from level to level."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width = width
        self.levels: list[Suffixes] = []

    def within(self, s: Suffixes) -> tuple[list[np.ndarray], Suffixes]:
        """The hits inside an array, and what of it is left."""
        same = np.concatenate([[False], s.gram[1:] == s.gram[:-1], [False]])
        some = np.flatnonzero(same[1:] | same[:-1])
        hits, whole = scan(s.take(some), self.width)
        left = np.ones(len(s), dtype=bool)
        left[some] = ~whole
        return hits, s.take(left)

    def add(self, s: Suffixes) -> Iterator[list[np.ndarray]]:
        """Hits that a new batch makes, in itself and with all levels; then it is a level."""
        hits, s = self.within(s)
        yield hits
        for k, level in enumerate(self.levels):
            here, there = np.flatnonzero(_shared(s.gram, level.gram)), np.flatnonzero(_shared(level.gram, s.gram))
            if not len(here):
                continue
            both = merged([s.take(here), level.take(there)], self.width)
            origin = np.argsort(np.concatenate([s.gram[here], level.gram[there]]), kind="stable")
            hits, ranked = scan(both, self.width)
            yield hits
            whole = np.empty(len(origin), dtype=bool)
            whole[origin] = ranked
            left, kept = np.ones(len(s), dtype=bool), np.ones(len(level), dtype=bool)
            left[here], kept[there] = ~whole[: len(here)], ~whole[len(here) :]
            s, self.levels[k] = s.take(left), level.take(kept)
        self.levels += [s] if len(s) else []
        # levels also shrink where their pieces are hit, so any two neighbours can be of equal size
        while (k := next((i for i, (a, b) in enumerate(zip(self.levels, self.levels[1:], strict=False)) if len(a) < 2 * len(b)), None)) is not None:
            self.levels[k : k + 2] = [merged(self.levels[k : k + 2], self.width)]


def _by_home(hits: list[list[np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    home, pos, count = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.lexsort((pos, home))
    edges = np.append(np.flatnonzero(np.diff(home[order], prepend=-1)), len(order))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = order[a:b]
        yield int(home[part[0]]), _squeeze(pos[part].astype(np.int64), count[part].astype(np.int64))


def _aliases(s: Suffixes, width: int) -> tuple[Suffixes, np.ndarray]:
    """s without pieces that repeat one of the same document, and (first window of the one that stays, own, count) of these."""
    if not len(s):
        return s, np.zeros((0, 3), np.int64)
    gram = np.cumsum(np.concatenate([[0], s.gram[1:] != s.gram[:-1]]))
    order = np.lexsort((s.n, s.doc, gram))
    alike = np.concatenate([[False], np.all([np.diff(x[order]) == 0 for x in (gram, s.doc, s.n)], axis=0)])
    some = order[alike | np.append(alike[1:], False)]
    if not len(some):
        return s, np.zeros((0, 3), np.int64)
    longest = width + int(s.n[some].max()) - 1
    size = s.n[some] + width - 1
    padded = np.zeros((len(some), longest), np.uint8)
    padded[np.repeat(np.arange(len(some)), size), _ranges(np.zeros(len(some), np.int64), size)] = s.text[_ranges(s.at[some], size)]
    text = padded.view(f"S{longest}").ravel()
    sort = np.lexsort((s.pos[some], text, s.n[some], s.doc[some], gram[some]))
    ranked, text = some[sort], text[sort]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | np.any([np.diff(x[ranked]) != 0 for x in (gram, s.doc, s.n)], axis=0)])
    first = ranked[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    again = ranked[~new]
    left = np.ones(len(s), dtype=bool)
    left[again] = False
    return s.take(left), np.stack([s.pos[first[~new]], s.pos[again], s.n[again]], axis=1)


def _codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (from bit 40 on) and 40-bit hash of each anchor."""
    g = mix(h ^ np.uint64(0x2545F4914F6CDD1D))
    return ((g >> np.uint64(40)) % np.uint64(buckets) << np.uint64(40)) | (g & _LOW)


def _groups(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of each run of a sorted array."""
    edges = np.append(np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])), len(sorted_keys)) if len(sorted_keys) else np.zeros(1, int)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(sorted_keys[a]), a, b


def _open(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as reader:
        return reader.read_next_batch()


def _slices(docs: DataFrame, text: str) -> DataFrame:
    """(home, blob): each slice of the documents in one row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())], pa.binary())], names=["blob"])

    rows = docs.mapInArrow(run, "blob binary").withColumn("home", F.monotonically_increasing_id())
    return materialize(rows, "slices")


def _body(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    data, at = buffers(part.column(text))
    return data[at[0] : at[-1]], at - at[0]


def _anchor_rows(rows: DataFrame, text: str, buckets: int, width: int) -> DataFrame:
    """(bucket, home, hashes): each slice's distinct anchors."""

    def run(batches):
        for batch in batches:
            for home, blob in zip(batch.column("home").to_pylist(), batch.column("blob"), strict=True):
                codes = np.unique(_codes(anchored(*_body(_open(blob.as_py()), text), width)[3], buckets))
                low = codes & _LOW
                out = [(b, home, _squeeze(np.ascontiguousarray(low[i:j].view(np.uint8).reshape(-1, 8)[:, :5].T))) for b, i, j in _groups(codes >> np.uint64(40))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "home", "hashes"])

    return rows.mapInArrow(run, "bucket int, home long, hashes binary")


def _same_bucket(batches, columns: tuple[str, ...]) -> Iterator[Iterator[tuple]]:
    """The rows of each bucket of a partition that is sorted by buckets."""
    from itertools import groupby

    rows = (r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in columns], strict=True))
    return (own for _, own in groupby(rows, key=lambda r: r[0]))


def _shared_rows(anchors: DataFrame) -> DataFrame:
    """(bucket, home, bits): which of a slice's anchors other slices have too."""

    def run(batches):
        for own in _same_bucket(batches, ("bucket", "home", "hashes")):
            keys, values = [], []
            for bucket, home, blob in own:
                planes = _expand(blob, "u1")[0].reshape(5, -1)
                full = np.zeros((planes.shape[1], 8), np.uint8)
                full[:, :5] = planes.T
                keys.append((bucket, home))
                values.append(full.view("<u8").ravel())
            ranked = np.sort(np.concatenate(values))
            twice = ranked[1:][ranked[1:] == ranked[:-1]]
            out = [(*k, np.packbits(flags).tobytes()) for k, v in zip(keys, values, strict=True) if (flags := _shared(v, twice)).any()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "home", "bits"])

    return anchors.mapInArrow(run, "bucket int, home long, bits binary")


def _piece_rows(rows: DataFrame, text: str, key: str, buckets: int, width: int) -> DataFrame:
    """(bucket, kind, home, blob): each slice's suffix array of shared anchors, its hits and its aliases."""

    def of_slice(home: int, part: pa.RecordBatch, shared: list) -> Iterator[tuple]:
        data, at = _body(part, text)
        first, n, anchor, h = anchored(data, at, width)
        codes, which, counts = np.unique(_codes(h, buckets), return_inverse=True, return_counts=True)
        wanted = counts > 1
        begin = {b: i for b, i, _ in _groups(codes >> np.uint64(40))}
        for x in shared:
            flags = np.unpackbits(np.frombuffer(x["bits"], np.uint8)).astype(bool)
            wanted[begin[x["bucket"]] : begin[x["bucket"]] + len(flags)] |= flags[: len(wanted) - begin[x["bucket"]]]
        own = np.flatnonzero(wanted[which])
        if not len(own):
            return
        first, n, anchor = first[own], n[own], anchor[own]
        doc = part.column(key).to_numpy()[np.searchsorted(at, first, "right") - 1]
        s = suffix_array(data, first, anchor, n, doc, np.full(len(own), home, np.int64), first)
        hits, s = Family(width).within(s)
        spread = home % buckets
        for h, blob in _by_home([hits]) if len(hits[0]) else ():
            yield spread, _HITS, h, blob
        s, same = _aliases(s, width)
        if len(same):
            yield spread, _ALIASES, home, _squeeze(same.astype(np.int64))
        left = np.searchsorted(first, s.pos)
        lead, bucket = (anchor - first)[left], (codes[which[own]] >> np.uint64(40))[left]
        order = np.argsort(bucket, kind="stable")
        for b, i, j in _groups(bucket[order]):
            p = s.take(order[i:j])
            yield b, _PIECES, home, _squeeze(p.n.astype(np.uint8), lead[order[i:j]].astype(np.uint8), p.doc, p.pos, s.text[_ranges(p.at, p.n + width - 1)])

    def run(batches):
        for batch in batches:
            for home, blob, shared in zip(batch.column("home").to_pylist(), batch.column("blob"), batch.column("shared"), strict=True):
                out = list(of_slice(home, _open(blob.as_py()), shared.as_py() or []))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "kind", "home", "blob"])

    return rows.mapInArrow(run, "bucket int, kind int, home long, blob binary")


def _hit_rows(pieces: DataFrame, width: int) -> DataFrame:
    """(kind, home, blob): all hits and aliases of each slice."""

    def batches_of(own) -> Iterator[Suffixes]:
        parts, size = [], 0
        for home, blob in own:
            n, lead, doc, pos, text = _expand(blob, "u1", "u1", "i8", "i8", "u1")
            n = n.astype(np.int64)
            at = np.cumsum(n + width - 1) - (n + width - 1)
            parts.append(suffix_array(text, at, at + lead, n, doc, np.full(len(n), home, np.int64), pos))
            size += len(n)
            if size >= BATCH:
                yield merged(parts, width)
                parts, size = [], 0
        if parts:
            yield merged(parts, width)

    def of_bucket(own) -> Iterator[tuple]:
        family, through = Family(width), []

        def arrive():
            for _, kind, home, blob in own:
                if kind == _PIECES:
                    yield home, blob
                else:
                    through.append((kind, home, blob))

        for batch in batches_of(arrive()):
            hits = [h for h in family.add(batch) if len(h[0])]
            yield from ((_HITS, home, blob) for home, blob in (_by_home(hits) if hits else ()))
            yield from through
            through.clear()
        yield from through

    def run(batches):
        for own in _same_bucket(batches, ("bucket", "kind", "home", "blob")):
            out = list(of_bucket(own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["kind", "home", "blob"])

    return pieces.mapInArrow(run, "kind int, home long, blob binary")


def covered(size: int, told: list, width: int) -> np.ndarray:
    """Which of a slice's bytes are removed."""
    edges = np.zeros(size + 1, dtype=np.int64)
    for x in told:
        if x["kind"] == _HITS:
            pos, count = _expand(x["blob"], "i8", "i8")
            np.add.at(edges, pos, 1)
            np.add.at(edges, pos + count, -1)
    hit = np.cumsum(edges[:-1]) > 0
    for x in told:
        if x["kind"] == _ALIASES:
            source, own, count = _expand(x["blob"], "i8")[0].reshape(-1, 3).T
            to = _ranges(own, count)
            hit[to] |= hit[_ranges(source, count)]
    total = np.cumsum(np.concatenate([[0], hit]))
    return total[1:] > total[np.maximum(np.arange(size) + 1 - width, 0)]


_FIELDS = [t.StructField("n_bytes", t.LongType()), t.StructField("n_removed", t.LongType()), t.StructField("spans", t.ArrayType(t.StructType([t.StructField("start", t.LongType()), t.StructField("end", t.LongType())]))), t.StructField("kept", t.BinaryType())]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with n_bytes, n_removed, spans (of removed bytes) and kept (the remaining bytes).

    ``width`` is 26 bytes at least. Removed stretches can begin and end inside a character, so
    kept is binary.
    """
    if width < GRAM + 2:
        raise ValueError(f"width is {GRAM + 2} at least, not {width}")
    order = unused(docs, "_order")
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    buckets = max(16, min(1 << 23, -(-size // BUCKET_BYTES)))
    parts = min(buckets, MAX_PARTS)
    # buckets are of about equal size, so they are dealt by number and not by a hash of it
    dealt = lambda df: df.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket")
    rows = _slices(docs.withColumn(order, F.coalesce(F.col(key).cast("long"), F.lit(_LAST))), text)
    shared = _shared_rows(dealt(_anchor_rows(rows, text, buckets, width))).groupBy("home").agg(F.collect_list(F.struct("bucket", "bits")).alias("shared"))
    hits = _hit_rows(dealt(_piece_rows(rows.join(shared, "home", "left"), text, order, buckets, width)), width)
    told = hits.groupBy("home").agg(F.collect_list(F.struct("kind", "blob")).alias("told"))
    names = {f.name.lower() for f in _FIELDS}
    kept = [c for c in docs.columns if c.lower() not in names]
    schema = t.StructType([docs.schema[c] for c in kept] + _FIELDS)

    def run(batches):
        for batch in batches:
            for blob, found in zip(batch.column("blob"), batch.column("told"), strict=True):
                part = _open(blob.as_py())
                data, at = _body(part, text)
                gone = covered(len(data), found.as_py() or [], width)
                total = np.cumsum(np.concatenate([[0], gone]))
                begins, ends = gone.copy(), gone.copy()
                begins[1:] &= ~gone[:-1]
                ends[:-1] &= ~gone[1:]
                bounds = at[:-1][np.diff(at) > 0]
                begins[bounds] |= gone[bounds]
                ends[at[1:][np.diff(at) > 0] - 1] |= gone[at[1:][np.diff(at) > 0] - 1]
                begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                first = np.searchsorted(begin, at)
                row = np.searchsorted(at, begin, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(begin - at[row]), pa.array(end - at[row])], names=["start", "end"])
                left = at - total[at]
                rest = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[~gone])])
                made = [pa.array(np.diff(at)), pa.array(np.diff(total[at])), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), spans).cast(_SPANS), rest]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, names=schema.names)

    return rows.join(told, "home", "left").mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = remove_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
