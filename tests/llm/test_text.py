"""Words, hashes and windows against regular expressions."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from kvspace.llm import text

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("chunk", [16, 1 << 19])
def test_words_and_windows(chunk, monkeypatch):
    monkeypatch.setattr(text, "CHUNK", chunk)
    text._powers.cache_clear()
    rng = random.Random(3)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("aB0 .é,ßZ\n日") for _ in range(rng.randrange(40))) for _ in range(300)]
    column = pa.array(texts).slice(5, 290)
    found, seen = text.words(column), {}
    for i, t in enumerate(texts[5:295]):
        expected = WORD.findall((t or "").translate(LOWER))
        span = range(found.first[i], found.first[i + 1])
        assert [found.data[found.starts[k] : found.ends[k]].tobytes().decode().translate(LOWER) for k in span] == expected
        for w, k in zip(expected, span, strict=True):
            assert seen.setdefault(w, found.hashes[k]) == found.hashes[k]
    assert len(set(seen.values())) == len(seen)
    for n in (1, 3, 10):
        at, _ = text.windows(found, n)
        assert at.tolist() == [found.first[i] + j for i in range(290) for j in range(found.counts()[i] - n + 1)]
    text._powers.cache_clear()


def test_slices_cover_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * (3 << 20), None, "", "b" * (9 << 20), "c"])], names=["text"])
    assert sum(s.num_rows for s in text.slices(batch, "text")) == 5
    assert list(text.slices(batch.slice(0, 0), "text")) == []
