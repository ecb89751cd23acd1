"""Fill-in-middle outputs against their definition, written from the draws alone; exact round trips."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvspace.llm import fim


def expected(doc_id, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, post = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{post}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{post}<M>{mid}"


TEXTS = [None, "", "a", "é", "日本語 text", "<P>", "x<S>y", "<P", "P>", "<", "a<M", "<<P>>", "😀" * 40, "plain words " * 9]


def test_transform_and_restore(spark, monkeypatch):
    rows = [(i, TEXTS[i % len(TEXTS)], "kept") for i in range(300)] + [(None, "no key", "kept"), (7, "twice", "kept"), (7, "twice", "kept"), (500, "long é " * 300_000, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").withColumnRenamed("form", "n")
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = fim.restore(made).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text)
        assert r.restored == (r.text or "")
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.digests(docs.limit(0)).count() == 0
    other = fim.transform(docs, seed=2).collect()
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected(r.doc_id, r.text, 2) for r in other)


def test_digests(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = sorted(tuple(r) for r in fim.digests(spark.createDataFrame(rows, "doc_id long, text string")).fillna(-1, ["prefix_chars", "middle_chars"]).collect())
    want = [(i, *[-1 if x is None else x for x in expected(i, s)[:4]], sha(expected(i, s)[4]), sha(s or "")) for i, s in rows]
    assert found == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aé日<PSM>", max_size=12), max_size=8), st.lists(st.integers(0, 2**32 - 1), min_size=32, max_size=32), st.integers(1, 9))
def test_blocks_of_any_size(texts, numbers, block):
    """Blocks that end anywhere give the same bytes."""
    import numpy as np

    drawn = np.array(numbers).reshape(4, 8)[:, : len(texts)]
    column = pa.array(texts, pa.string())
    with pytest.MonkeyPatch.context() as m:
        whole = fim._transformed(column, drawn)
        m.setattr(fim, "CHUNK", block)
        parts = fim._transformed(column, drawn)
        assert [x.to_pylist() for x in whole] == [x.to_pylist() for x in parts]
        assert fim._restored(parts[4], parts[1].to_pylist()).to_pylist() == texts


def test_damaged_outputs_are_refused():
    with pytest.raises(ValueError):
        fim._restored(pa.array(["<P>a<S>b"]), ["psm"])
