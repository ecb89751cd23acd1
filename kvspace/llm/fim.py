"""Fill-in-middle transformation by displacement scatter.

A text is cut at two code points into prefix, middle and suffix, and the parts are told apart
by sentinels: psm puts the suffix before the middle, spm puts it first. A batch's bytes are
scanned for cuts once; the parts' displacements go into a difference array at the places where
parts begin, so that one cumulative sum gives every byte its shift and one scatter writes all
outputs of the batch. ``restore`` finds the sentinels again and gathers by the inverse shifts.

The draws depend on the key and the seed alone: repeated keys are drawn alike, and a null key
draws like an empty one. Null texts count as empty; empty texts and texts with a sentinel stay
plain, so that a restored text is always exact. Texts of any length are worked on whole, in
blocks of CHUNK bytes. An empty table gives an empty result. Columns that have the name of an
added one are replaced, others kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from kvspace.llm.text import CHUNK, buffers, extend, unused

# The sentinels, and the shares in percent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = 1

_OPEN, _CLOSE = PREFIX[0], PREFIX[2]
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[PREFIX[1], SUFFIX[1], MIDDLE[1]]] = True
_MARK = len(PREFIX)
FORMS = np.array(["plain", "psm", "spm"], dtype=object)


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 from the digest of the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _sentinels(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, row) of every sentinel that lies within a row."""
    spot = np.flatnonzero((body[:-2] == _OPEN) & (body[2:] == _CLOSE) & _LETTER[body[1:-1]])
    row = np.searchsorted(at, spot, "right") - 1
    inside = spot + _MARK <= at[row + 1]
    return spot[inside], row[inside]


def _shifts(points: np.ndarray, shifts: np.ndarray, size: int):
    """(begin, end, shift of each byte) in blocks; from points[k] on, bytes are shifted by shifts[k].

    Points rise; where several are equal, the parts between them are empty and the last counts.
    """
    deltas = np.diff(shifts, prepend=0)
    carried = 0
    for a in range(0, size, CHUNK):
        b = min(a + CHUNK, size)
        lo, hi = np.searchsorted(points, (a, b))
        moved = np.zeros(b - a, dtype=np.int64)
        np.add.at(moved, points[lo:hi] - a, deltas[lo:hi])
        moved[0] += carried
        np.cumsum(moved, out=moved)
        carried = int(moved[-1])
        yield a, b, moved


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


def _transformed(column: pa.Array, drawn: np.ndarray) -> list[pa.Array]:
    data, at = buffers(column)
    body, at = data[at[0] : at[-1]], at - at[0]
    begin, end = at[:-1], at[1:]
    leads = np.flatnonzero((body & 0xC0) != 0x80)
    first = np.searchsorted(leads, at)
    n = np.diff(first)
    a, b = drawn[0] % (n + 1), drawn[1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    leads = np.append(leads, len(body))
    cut = lambda k: np.where(k < n, leads[np.minimum(first[:-1] + k, len(leads) - 1)], end)
    form = np.where(drawn[3] % 100 < SUFFIX_FIRST, 2, 1)
    form[(n == 0) | (drawn[2] % 100 >= TRANSFORMED)] = 0
    form[_sentinels(body, at)[1]] = 0
    one, two = cut(low), cut(high)
    marks = np.where(form > 0, _MARK, 0)
    placed = _starts(end - begin + 3 * marks)
    start, pre, post = placed[:-1], one - begin, end - two
    ahead = np.where(form == 2, post + marks, 0)  # what stands before the prefix's sentinel
    behind = np.where(form == 1, pre + marks, 0)
    prefix, suffix = start + ahead + marks - begin, start + behind + marks - two
    middle = start + pre + post + 3 * marks - one
    plain = form == 0
    for shift in (prefix, middle, suffix):
        shift[plain] = (start - begin)[plain]
    out = np.empty(placed[-1], dtype=np.uint8)
    for a, b, moved in _shifts(np.stack([begin, one, two], axis=1).ravel(), np.stack([prefix, middle, suffix], axis=1).ravel(), len(body)):
        out[np.arange(a, b) + moved] = body[a:b]
    made = form > 0
    for mark, where in ((PREFIX, start + ahead), (SUFFIX, start + behind), (MIDDLE, start + pre + post + 2 * marks)):
        for k, byte in enumerate(mark):
            out[where[made] + k] = byte
    sized = lambda x: pa.array(x.astype(np.int64), mask=plain)
    return [pa.array(n.astype(np.int64)), pa.array(FORMS[form]), sized(low), sized(high - low), _strings(out, placed)]


def _restored(column: pa.Array, form: list[str | None]) -> pa.Array:
    data, at = buffers(column)
    body, at = data[at[0] : at[-1]], at - at[0]
    begin, end = at[:-1], at[1:]
    code = np.array([0 if f is None else int(np.flatnonzero(FORMS == f)[0]) for f in form], dtype=np.int64)
    spot, row = _sentinels(body, at)
    spot, row = spot[code[row] > 0], row[code[row] > 0]
    made = np.flatnonzero(code)
    if len(row) != 3 * len(made) or (row.reshape(-1, 3) != made[:, None]).any():
        raise ValueError("an output has other sentinels than its form says")
    second, third = end.copy(), end.copy()
    second[made], third[made] = spot.reshape(-1, 3)[:, 1], spot.reshape(-1, 3)[:, 2]
    marks = np.where(code > 0, _MARK, 0)
    placed = _starts(end - begin - 3 * marks)
    one, two = second - begin - marks, third - second - marks  # the parts that stand first and second
    one[code == 0], two[code == 0] = (end - begin)[code == 0], 0
    pre, post = np.where(code == 2, two, one), np.where(code == 2, one, two)
    start = placed[:-1]
    middle = placed[1:] - post
    from_prefix = np.where(code == 2, second, begin) + marks - start
    from_suffix = np.where(code == 2, begin, second) + marks - middle
    from_middle = third + marks - (start + pre)
    out = np.empty(placed[-1], dtype=np.uint8)
    for a, b, moved in _shifts(np.stack([start, start + pre, middle], axis=1).ravel(), np.stack([from_prefix, from_middle, from_suffix], axis=1).ravel(), len(out)):
        out[a:b] = body[np.arange(a, b) + moved]
    return _strings(out, placed)


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """docs with n (code points), form, prefix_chars, middle_chars (null if plain) and output."""
    names = [unused(docs, f"_draw{k}") for k in range(4)]
    fields = [t.StructField("n", t.LongType()), t.StructField("form", t.StringType()), t.StructField("prefix_chars", t.LongType()), t.StructField("middle_chars", t.LongType()), t.StructField("output", t.StringType())]

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        return _transformed(part.column(text), np.stack([part.column(c).to_numpy() for c in names]))

    return extend(docs.withColumns(dict(zip(names, draws(F.col(key), seed), strict=True))), text, fields, make).drop(*names)


def restore(made: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """made with ``restored``, the text rebuilt from the output and its form alone; a null form is plain."""
    return extend(made, output, [t.StructField("restored", t.StringType())], lambda part: [_restored(part.column(output), part.column(form).to_pylist())])


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars and the digests of output and restored text."""
    back = restore(transform(docs.select("doc_id", "text")).drop("text"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
