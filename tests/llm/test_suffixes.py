"""Removed stretches against a search over all strings of a width, and the arrays against sorted suffixes."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvspace.llm import suffixes

WIDTH = suffixes.WIDTH


def expected(rows, width=WIDTH):
    least = {}
    key = lambda k: math.inf if k is None else k
    raws = [(key(k), (s or "").encode()) for k, s in rows]
    for k, raw in raws:
        for i in range(len(raw) - width + 1):
            least[raw[i : i + width]] = min(k, least.get(raw[i : i + width], math.inf))
    out = []
    for k, raw in raws:
        gone = [False] * len(raw)
        for i in range(len(raw) - width + 1):
            if least[raw[i : i + width]] < k:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((None if k == math.inf else k, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(docs):
    return sorted((tuple(r) for r in suffixes.report(docs).collect()), key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(40), "the same line of a footer that everybody has, word for word\n"
    rows = [(i, prose(rng.randint(0, 80))) for i in range(150)]
    rows += [(200 + i, prose(5) + passage[: rng.randint(30, 200)] + prose(5)) for i in range(60)]
    rows += [(300 + i, line * rng.randint(1, 4) + prose(3)) for i in range(60)]
    rows += [(400 + i, passage) for i in range(40)] + [(400, passage), (401, passage + "x"), (None, passage), (None, passage)]
    rows += [(500, "a" * 4000), (499, "ab" * 300), (501, "a" * 60), (502, "ba" * 300 + "c"), (503, None), (504, ""), (505, "a" * 49), (-3, "a" * 50), (506, "\0" * 80), (507, "\0" * 70)]
    exact = prose(30).encode()[:120].decode(errors="ignore")
    rows += [(600 + k, prose(3) + exact[7 : 7 + n] + prose(3)) for k, n in enumerate((20, 25, 26, 30, 40, 48, 49, 50, 51, 60))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [(4 << 20, 50_000, 1_000_000), (3000, 7, 40)])
def test_against_all_strings(spark, monkeypatch, sizes):
    """One slice and one batch, then many slices, levels and blocks."""
    from kvspace.llm import text

    rows = corpus()
    monkeypatch.setattr(text, "SLICE", sizes[0])
    monkeypatch.setattr(suffixes, "BATCH", sizes[1])
    monkeypatch.setattr(suffixes, "SORTED", sizes[2])
    rows_of = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(rows_of) == expected(rows)


def test_spans_and_columns(spark):
    rows = [(1, "x" + "0123456789" * 6, "a"), (2, "é" + "0123456789" * 6 + "yy", "b"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumnRenamed("kept", "home")
    made = suffixes.remove_repeats(docs)
    assert made.columns == ["doc_id", "text", "home", "n_bytes", "n_removed", "spans", "kept"]
    got = {r.doc_id: r for r in made.collect()}
    assert [tuple(s) for s in got[2].spans] == [(2, 62)] and bytes(got[2].kept) == "éyy".encode() and got[2].home == "b"
    assert got[1].n_removed == 0 and bytes(got[1].kept) == rows[0][1].encode() and got[3].n_bytes == 0
    assert suffixes.report(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.remove_repeats(docs, width=20)


def test_other_width(spark):
    rows = [(k, t) for k, t in corpus(8) if k is None or k < 450]
    made = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width=30).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in made), key=repr) == expected(rows, 30)


def array(rows, home, width=WIDTH):
    raws = [(k, s.encode()) for k, s in rows]
    data, at = np.frombuffer(b"".join(r for _, r in raws), np.uint8), np.cumsum([0, *[len(r) for _, r in raws]])
    first, n, anchor, _ = suffixes.anchored(data, at, width)
    doc = np.array([k for k, _ in raws])[np.searchsorted(at, first, "right") - 1]
    return suffixes.suffix_array(data, first, anchor, n, doc, np.full(len(n), home), first)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=150), min_size=1, max_size=12), st.integers(1, 64))
def test_anchors_cover_all_windows(texts, chunk):
    """Every window is in one piece, and equal windows have equal anchors."""
    raws = [s.encode() for s in texts]
    data, at = np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffixes, "CHUNK", chunk)
        first, n, anchor, _ = suffixes.anchored(data, at)
    windows = [(w, a - w) for f, c, a in zip(first.tolist(), n.tolist(), anchor.tolist(), strict=True) for w in range(f, f + c)]
    assert sorted(w for w, _ in windows) == [b + i for b, r in zip(at.tolist(), raws, strict=False) for i in range(len(r) - WIDTH + 1)]
    lead = {}
    for w, k in windows:
        assert 0 <= k <= WIDTH - suffixes.GRAM
        assert lead.setdefault(data[w : w + WIDTH].tobytes(), k) == k


def test_levels():
    rows = [r for r in corpus(3) if r[0] is not None and r[1]]
    family, hits = suffixes.Family(), set()
    for home in range(24):
        batch = [(int(k), s) for k, s in rows[home::24]]
        for h, p, c in family.add(array(batch, home)):
            hits |= {(a, b + i) for a, b, n in zip(h.tolist(), p.tolist(), c.tolist(), strict=True) for i in range(n)}
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and all((x.gram[1:] >= x.gram[:-1]).all() for x in family.levels)
    least = {}
    for k, s in rows:
        raw = s.encode()
        for i in range(len(raw) - WIDTH + 1):
            least[raw[i : i + WIDTH]] = min(k, least.get(raw[i : i + WIDTH], math.inf))
    want = set()
    for home in range(24):
        at = 0
        for k, s in rows[home::24]:
            raw = s.encode()
            want |= {(home, at + i) for i in range(len(raw) - WIDTH + 1) if least[raw[i : i + WIDTH]] < k}
            at += len(raw)
    assert hits == want
