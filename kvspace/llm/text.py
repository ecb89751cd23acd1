"""Word spans and word hashes of whole Arrow string columns, without a loop over words.

A word is a maximal run of ``[0-9a-z]`` or non-ASCII characters after A-Z are lower-cased.
In UTF-8 that is a property of single bytes, so the boundaries of all words of a batch come
from one table lookup. A word's hash is a polynomial over its bytes modulo 2**64, taken
from one running sum over the buffer; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the temporary arrays to a few dozen MB.
CHUNK = 1 << 19
#: Text bytes per slice of a batch that the operators work on at a time.
SLICE = 4 << 20
#: Text bytes per slice where arrays of many times its size are made of it; a worker keeps what it once took.
SMALL = 1 << 20

_U = np.uint64
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, dtype=_U), np.full(n, pow(base, -1, 1 << 64), dtype=_U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


@cache
def _values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))[_LOWER]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null has no bytes."""
    large = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    _, offsets, data = large.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[large.offset : large.offset + len(large) + 1] if len(large) else np.zeros(1, np.int64)
    if large.null_count:  # a null may cover bytes
        sizes = np.diff(at) * np.asarray(large.is_valid())
        if sizes.sum() != at[-1] - at[0]:
            return buffers(large.fill_null(""))
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` (SLICE) bytes of text, one row at least."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + (most or SLICE), "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


@dataclass
class Words:
    """All words of a column: byte spans in ``data``, hashes, and each row's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # rows + 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(column: pa.Array) -> Words:
    data, at = buffers(column)
    lo, hi = int(at[0]), int(at[-1])
    body = data[lo:hi]
    inside = _IS_WORD[body]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(body):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[0] = after[-1] = False
        bounds = at[:-1][np.diff(at) > 0] - lo
        before[bounds] = False
        after[bounds[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), dtype=_U)
    value = _values()
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(int(np.searchsorted(ends, a + CHUNK, "right")), i + 1)
        n = int(ends[j - 1] - a)
        up, down = _powers(CHUNK) if n <= CHUNK else _powers.__wrapped__(n)
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum(value[body[a : a + n]] * up[:n], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        hashes[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
        i = j
    first = np.searchsorted(starts, at - lo)
    return Words(data, starts + lo, ends + lo, hashes, first)


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of n words that stays in its row."""
    total = len(w.hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    acc = np.zeros(total, dtype=_U)
    factor = 1
    for j in range(n):
        acc += w.hashes[j : j + total] * _U(factor)
        factor = factor * 0xA0761D6478BD642F % (1 << 64)
    fits = np.ones(total, dtype=bool)
    inner = w.first[1:-1]
    inner = inner[(inner > 0) & (inner < len(w.hashes))]
    for back in range(1, n):  # a window that begins less than n words before a row's first word crosses into that row
        k = inner - back
        k = k[(k >= 0) & (k < total)]
        fits[k] = False
    keep = np.flatnonzero(fits)
    return keep, mix(acc[keep] + _U(n))


def count_before(data: np.ndarray, at: int, points: np.ndarray) -> np.ndarray:
    """Code points of data[at:p] for sorted byte positions p."""
    if not len(points):
        return np.zeros(0, np.int64)
    lead = (data[at : points[-1]] & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(lead)])
    return total[points - at]


def unused(df, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def extend(df, column: str, fields, make, keep: list[str] | None = None, most: int | None = None):
    """df (or its columns ``keep``) with the columns ``fields`` that ``make`` adds.

    ``make`` gets a record batch of about ``most`` (SLICE) bytes of ``column`` and returns one Arrow
    array for each field. Columns of df that have a field's name are replaced.
    """
    from pyspark.sql import types as t

    names = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    carried = list(dict.fromkeys([*kept, column]))
    schema = t.StructType([df.schema[c] for c in kept] + list(fields))
    titles = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, most):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + make(part), names=titles)

    return df.select(*carried).mapInArrow(run, schema)
