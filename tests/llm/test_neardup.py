"""Near-duplicates against a comparison of all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kvspace.llm import neardup


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([8, 40, 300]))]
        texts.append(base)
        for _ in range(rng.randrange(4)):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, len(base) // 12])):
                near[rng.randrange(len(near))] = word()
            texts.append(near)
    hot = [word() for _ in range(200)]
    for _ in range(40):
        near = list(hot)
        for _ in range(rng.choice([1, 2, 3, 5])):
            near[rng.randrange(len(near))] = word()
        texts.append(near)
    return [" ".join(t) for t in texts]


def brute(docs, similarity=0.8):
    """Classes from the words alone: all pairs, by the definition."""
    counted = []
    for _, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall("[0-9a-z\\x80-\U0010ffff]+", low)
        counted.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    df = Counter(g for c in counted for g in c)
    n = len(docs)
    weigh = lambda c: {g: k * (1 + math.log(n / max(df[g], n / 1000))) for g, k in c.items()}
    sets = [weigh(c) for c in counted]
    sums = [sum(x.values()) for x in sets]
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if not sets[i] or not sets[j]:
                linked = not sets[i] and not sets[j] and (docs[i][1] or "") == (docs[j][1] or "")
            else:
                both = sum(min(v, sets[j].get(g, 0)) for g, v in sets[i].items())
                linked = both >= similarity * (sums[i] + sums[j] - both) - 1e-9
            if linked:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    ids = {}
    for i, (doc, _) in enumerate(docs):
        ids.setdefault(top(i), []).append(doc)
    return {doc: min(ids[top(i)]) for i, (doc, _) in enumerate(docs)}


def test_classes(spark):
    docs = list(enumerate(corpus(), 100)) + [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (6, "one"), (7, "rep " * 30_000), (8, "rep " * 30_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS node", "0 AS class_id")
    expected = brute(docs)
    found = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(frame).collect()}
    assert {k: v[0] for k, v in found.items()} == expected
    sizes = {c: list(expected.values()).count(c) for c in expected.values()}
    assert all(size == sizes[c] for c, size in found.values())
    kept = neardup.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_null_ids(spark):
    """Every other text has no id, leaders of large buckets among them; classes must not depend on it."""
    texts = corpus()
    frame = spark.createDataFrame([(None if i % 2 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    root = brute(list(enumerate(texts)))
    members = {}
    for i, r in root.items():
        members.setdefault(r, []).append(i)
    least = {r: min((i for i in m if i % 2 == 0), default=None) for r, m in members.items()}
    assert None in least.values()
    expected = [(None if i % 2 else i, least[r], len(members[r])) for i, r in root.items()]
    assert sorted(map(tuple, neardup.near_duplicates(frame).collect()), key=repr) == sorted(expected, key=repr)
    at = {t: root[i] for i, t in enumerate(texts)}
    kept = neardup.deduplicate(frame).collect()
    assert sorted(at[r.text] for r in kept) == sorted(members)
    assert all(r.doc_id == least[at[r.text]] for r in kept)


def test_null_id_leader(spark):
    """The copied central text has no id, nor has a text of its own class."""
    word = lambda i: f"w{i:04d}"
    base = [word(i) for i in range(200)]
    changed = lambda *at: " ".join(f"x{at[0]}" if i in at else w for i, w in enumerate(base))
    texts = [" ".join(base)] * 3 + [changed(5), changed(60), changed(120)]
    frame = spark.createDataFrame([(None, t) for t in texts[:3]] + [(i, t) for i, t in enumerate(texts[3:])] + [(None, "quite another text that stands alone")], "doc_id long, text string")
    rows = neardup.near_duplicates(frame).collect()
    assert sorted((r.doc_id is None, r.class_id is None, r.class_size) for r in rows) == [(False, False, 6)] * 3 + [(True, False, 6)] * 3 + [(True, True, 1)]
    assert sorted((r.doc_id is None, r.text[:5]) for r in neardup.deduplicate(frame).collect()) == [(False, "w0000"), (True, "quite")]


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words are in this one"), (2, "A b, c d e f")], "doc_id long, text string")
    assert sorted(r.class_id for r in neardup.near_duplicates(docs).collect()) == [1, 1, 1, 1]
    named = docs.selectExpr("*", "1 AS number", "'x' AS node", "2 AS _number", "3 AS root", "4 AS part")
    assert [tuple(r)[2:] for r in neardup.deduplicate(named).collect()] == [(1, "x", 2, 3, 4)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(bytes([i + 1]), bytes([i])) for i in range(40) if i != 20], "a binary, b binary")
    roots = {bytes(r.node)[0]: bytes(r.root)[0] for r in neardup.components(chain).collect()}
    assert roots == {i: (0 if i <= 20 else 21) for i in range(41) if i not in (0, 21)}


@pytest.mark.parametrize("weights", ["equal", "unequal"])
def test_sampling_estimates_similarity(weights):
    """Shared boilerplate of little weight, own text of much: the samples follow the weighted similarity."""
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 32, 3000, dtype=np.uint32))[:1500]
    pool = rng.permutation(pool)
    a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:600], pool[1000:1400]]))
    of = dict(zip(pool.tolist(), (np.where(np.arange(1500) < 600, 1.0, 8.0) if weights == "unequal" else np.ones(1500)).tolist(), strict=True))
    row = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    shingle = np.concatenate([a, b])
    w = np.array([of[x] for x in shingle.tolist()])
    shared = sum(of[x] for x in set(a.tolist()) & set(b.tolist()))
    expected = shared / (w.sum() - shared)
    keys = neardup._bands(row, shingle, w, 2, 1200, 1)
    assert abs((keys[0] == keys[1]).mean() - expected) < 0.06
    assert expected < 0.15 if weights == "unequal" else abs(expected - 600 / 1400) < 1e-9
    doubled = np.where(row == 0, 2 * w, w)  # half the weight, the same shingles
    same = neardup._bands(np.concatenate([np.zeros(len(a), int), np.ones(len(a), int)]), np.concatenate([a, a]), np.concatenate([doubled[row == 0], w[row == 0]]), 2, 1200, 1)
    assert abs((same[0] == same[1]).mean() - 0.5) < 0.06


def test_weights_are_exact(spark):
    """Counts of all shingles that reach the floor, whatever the blocks; a table of bounded size."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words[: rng.choice([2, 3, 40])]) for _ in range(rng.randrange(4, 30))) for _ in range(600)]
    df = Counter(g for x in texts for g in {tuple(x.split()[i : i + 5]) for i in range(max(1, len(x.split()) - 4))})
    frame = spark.createDataFrame([(x,) for x in texts], "text string").repartition(7)
    for floor in (0.001, 0.02):
        idf = neardup.inverse_frequency(frame, floor)
        expected = sorted(1 + math.log(600 / v) for v in df.values() if v >= floor * 600)
        assert np.allclose(np.sort(idf.weights), expected) and abs(idf.rest - 1 - math.log(600 / max(1, floor * 600))) < 1e-9
    few = neardup.inverse_frequency(frame, 0.001, most=50)
    assert len(few.shingles) <= 50 and np.allclose(np.sort(few.weights), sorted(1 + math.log(600 / v) for v in df.values())[: len(few.shingles)])


def test_large_group(spark):
    """One text with many more or less changed copies, chains of copies of copies, and a second group near to it."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    change = lambda text, n: [word() if i in set(rng.sample(range(len(text)), n)) else w for i, w in enumerate(text)]
    base = [word() for _ in range(150)]
    second = change(base, 5)
    texts = [base] + [change(base, rng.randrange(1, 8)) for _ in range(150)] + [second] + [change(second, rng.randrange(1, 5)) for _ in range(60)]
    chain = base
    for _ in range(12):
        chain = change(chain, 2)
        texts.append(chain)
    texts += [x[: rng.randrange(100, 150)] for x in rng.sample(texts, 40)] + [x + ["tail", *base[:20]] for x in rng.sample(texts, 20)]
    docs = list(enumerate(" ".join(x) for x in texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute(docs)
    assert 5 < len(set(expected.values())) < len(docs) - 50
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(frame, bands=60, rows=4).collect()} == expected


def test_small_tables_are_not_sent_through_the_driver(spark, monkeypatch):
    """Inside, joins of small tables are shuffled; afterwards the session's threshold is what it was."""
    key, seen = "spark.sql.autoBroadcastJoinThreshold", []
    real = neardup.class_roots
    monkeypatch.setattr(neardup, "class_roots", lambda docs, *more: seen.append(spark.conf.get(key)) or real(docs, *more))
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{k}" for k in range(30))) for i in range(9)], "doc_id long, text string")
    for before in ("300k", None):
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
        default = spark.conf.get(key)
        try:
            assert sorted(r.class_id for r in neardup.near_duplicates(docs).collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
            assert seen.pop() == "-1" and spark.conf.get(key) == default
        finally:
            spark.conf.unset(key)
