"""Packing: tokens against the tokenizer, a whole placement, and waste against the bound."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from kvspace.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["İstanbul ΣΑΣ ς test\x1cabc", "don't it's I'M 12a3 b.c, d..", "a b c", "é ́x", "日本語 テキスト. ok", "<|endoftext|> x", "ǅ ŉ ẞ ÀÉß", "", "  ", "...,", "x'll've 'tis", None]


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]


def test_tokens():
    found = packing.token_bytes([t or "" for t in ODD], PATH)
    assert [np.frombuffer(b, "<u4").tolist() + [0] for b in found] == [ids_of(t) for t in ODD]


def test_frequent_words_stay_remembered(monkeypatch):
    """However many words of one text come by, words of every text are asked for once, and memory is bounded."""
    real, memory, _ = packing._tokenizer.__wrapped__(PATH)
    asked = Counter()

    class Counting:
        model = property(lambda self: self)

        def tokenize(self, unit):
            asked[unit] += 1
            return real.model.tokenize(unit)

        def encode_batch(self, texts, **kw):
            return real.encode_batch(texts, **kw)

    monkeypatch.setattr(packing, "MEMORY", 300)
    monkeypatch.setattr(packing, "_tokenizer", lambda path: (Counting(), memory, True))
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    for k in range(12):
        text = " ".join([f"often{letters(i)}" for i in range(60)] + [f"once{letters(100 * k + i)}." for i in range(60)] + ["12a3"])
        assert np.frombuffer(packing.token_bytes([text], PATH)[0], "<u4").tolist() + [0] == ids_of(text)
    assert asked["oftena"] == 1 and max(asked.values()) == 1
    assert sum(map(len, memory)) <= 300 + 2 * 121


def test_white_space_and_signs_of_any_kind():
    rng = random.Random(5)
    signs = "aBé\u00c0\u00df '\t\n\x0b\x0c\r\x1b\x1c\x1f\x00\x85\xa0.,-_12!<|>s\u0100\u0130\u0149\u01c5\u01f0\u024f\u0250\u4e00\u2003"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(1500)]
    own = Tokenizer.from_file(PATH)
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.token_bytes(texts, PATH)] == [own.encode(x, add_special_tokens=False).ids for x in texts]


def test_placement(spark):
    rng = random.Random(4)
    texts = ODD + ["word " * rng.choice([3, 50, 400, 1500, 2047, 2048, 5000]) + f"end {i}" for i in range(60)] + ["same text"] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS offset")
    rows = packing.pack_documents(docs, PATH).collect()
    own, places = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids = ids_of(t)
        expected = [(k, a, min(2048, len(ids) - a), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own[i]) == sorted(expected * (2 if i == 0 else 1))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_plan_uses_every_piece_and_little_room():
    rng = random.Random(7)
    for _ in range(20):
        pieces = Counter(rng.choice([rng.randrange(1, 2049), rng.randrange(1, 300)]) for _ in range(rng.randrange(1, 3000)))
        bins = packing.plan(pieces)
        used = Counter()
        for times, filling in bins:
            assert sum(filling) <= 2048
            for x in filling:
                used[x] += times
        assert used == pieces
        total = sum(k * v for k, v in pieces.items())
        halves = sum(v for k, v in pieces.items() if k > 1024)
        assert sum(t for t, _ in bins) <= max(halves, -(-total // 2048)) + 2


def fillings(counts, space):
    """All multisets of the counted lengths that fit."""
    if not counts:
        return [()]
    (x, n), rest = counts[0], counts[1:]
    return [(x,) * k + f for k in range(min(n, space // x) + 1) for f in fillings(rest, space - k * x)]


def dominated(filling, counts, space):
    """Whether one or two lengths left could replace members that they are at least as large as."""
    left = Counter(counts)
    left.subtract(filling)
    spare = sorted(left.elements())
    for size in (1, 2):
        for new in set(combinations(spare, size)):
            for k in range(1, len(filling) + 1):
                for old in set(combinations(filling, k)):
                    if sum(filling) - sum(old) + sum(new) > space or sorted(old) == sorted(new):
                        continue
                    if size == 1 and new[0] >= sum(old):
                        return True
                    if size == 2 and any(sum(one) <= new[0] and sum(old) - sum(one) <= new[1] and 0 < sum(one) < sum(old) for m in range(1, k) for one in combinations(old, m)):
                        return True
    return False


def test_completion_against_all_fillings():
    rng = random.Random(3)
    seen = 0
    for _ in range(150):
        capacity = rng.randrange(20, 60)
        pieces = Counter(rng.randrange(1, capacity) for _ in range(rng.randrange(2, 9)))
        lengths = sorted(pieces)
        largest = lengths[-1]
        own = pieces - Counter([largest])
        space = capacity - largest
        every = fillings(sorted(own.items()), space)
        least = min(space - sum(f) for f in every)
        for allowance in (0, 3):
            found = packing.completion(largest, dict(pieces), lengths, capacity, allowance)
            assert not Counter(found) - own and space - sum(found) <= least + allowance
            good = [tuple(sorted(f, reverse=True)) for f in every if space - sum(f) <= least + allowance]
            assert tuple(found) == max(good)
            assert not dominated(tuple(found), own, space)
        seen += any(dominated(f, own, space) for f in every)
    assert seen >= 20


def test_packings_of_small_sets():
    """Against the least number of bins, by search over all placements."""

    def least(items, bins, best, capacity):
        if len(bins) >= best:
            return best
        if not items:
            return len(bins)
        for k in sorted({b: k for k, b in enumerate(bins)}.values()):
            if bins[k] + items[0] <= capacity:
                bins[k] += items[0]
                best = least(items[1:], bins, best, capacity)
                bins[k] -= items[0]
        return least(items[1:], [*bins, items[0]], best, capacity)

    rng = random.Random(6)
    for _ in range(500):
        capacity = rng.choice([30, 50, 100])
        items = sorted((rng.randrange(capacity // 10, capacity * 17 // 20) for _ in range(rng.randrange(5, 12))), reverse=True)
        found = packing.planned(Counter(items), capacity)
        total = sum(n for n, _ in found.bins)
        exact = least(items, [], 12, capacity)
        assert found.bound <= exact == total and found.proven and found.gap == 0
        assert sorted(x for n, f in found.bins for x in f * n) == sorted(items) and all(sum(f) <= capacity for _, f in found.bins)
        assert sum(n * len(f) for n, f in packing.best_fit_bins(Counter(items), capacity)) == len(items)
    assert sum(n for n, _ in packing.plan(Counter([42, 36, 53, 39, 31, 23, 44, 43, 15, 15, 48]), 100)) == 4


def test_undominated_fillings():
    """All fillings that nothing dominates are enumerated, the least waste first."""
    rng = random.Random(8)
    for _ in range(120):
        capacity = rng.randrange(20, 50)
        pieces = Counter(rng.randrange(1, capacity) for _ in range(rng.randrange(2, 8)))
        lengths = sorted(pieces)
        own = pieces - Counter([lengths[-1]])
        space = capacity - lengths[-1]
        found = [tuple(f) for f in packing.undominated(lengths[-1], dict(pieces), lengths, capacity, space)]
        every = {tuple(sorted(f, reverse=True)) for f in fillings(sorted(own.items()), space)}
        assert len(set(found)) == len(found) and set(found) <= every
        fits = lambda f: min((own - Counter(f)).elements(), default=space + 1) <= space - sum(f)
        assert {f for f in every if not fits(f) and not dominated(f, own, space)} <= set(found)
        assert [sum(f) for f in found] == sorted((sum(f) for f in found), reverse=True)


def test_gap_of_large_tables():
    rng = random.Random(1)
    found = packing.planned(Counter(rng.randrange(300, 1100) for _ in range(3000)), effort=2000)
    total = sum(n for n, _ in found.bins)
    assert found.gap == (0 if found.proven else total - found.bound) and total - found.bound <= 25


def test_bound_is_reached_on_texts_of_usual_lengths():
    rng = random.Random(9)
    pieces = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20_000))
    assert sum(n for n, _ in packing.plan(pieces)) == packing.lower_bound(pieces)


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = ["two  words here", "Tabs\tand \n lines", "don't"]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.token_bytes(texts, path)] == [own.encode(x, add_special_tokens=False).ids for x in texts]


def test_completion_finds_the_exact_filling():
    counts = {700: 1, 600: 1, 650: 2, 400: 1, 348: 1, 1000: 1}
    assert sum(packing.completion(1000, counts, sorted(counts), 2048)) == 1048  # best fit alone would take 700 and 348
    counts = {1000: 1, 699: 1, 524: 2}
    assert sorted(packing.completion(1000, counts, sorted(counts), 2048)) == [524, 524]


def test_workers_get_little_text_at_once(spark, monkeypatch):
    """A worker keeps the memory that it once took: texts are looked up a MB at a time, and batches are bounded in bytes."""
    import pyarrow as pa

    from kvspace.llm.store import BATCH, small_batches

    class Caught:
        def select(self, *columns):
            return self

        schema = {"doc_id": T.StructField("doc_id", T.LongType())}

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    asked = []
    monkeypatch.setattr(packing, "token_bytes", lambda texts, path: asked.append(sum(map(len, texts))) or [b""] * len(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(["some words " * 1000] * 800)], names=["doc_id", "text"])
    assert sum(b.num_rows for b in packing.pieces(Caught(), PATH).run([batch])) == 800
    assert sum(asked) == 800 * 11_000 and max(asked) <= 1 << 20

    docs = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('some words ', 1000) AS text")
    sizes = lambda: [r.n for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()]
    with small_batches(spark):
        assert max(sizes()) < BATCH + 20_000
    assert max(sizes()) > 4 * BATCH  # what a session sets is left as it was
