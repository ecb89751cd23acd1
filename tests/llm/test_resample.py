"""Gains, weights and draws against a version written from the words alone."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from kvspace.llm import ranks, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=1):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def expected(docs, target, longest=1, percent=10, min_words=20):
    count = lambda rows: Counter(zlib.crc32(f.encode()) % 10000 for _, text in rows for f in features(text, longest)[1])
    s, t = count(docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000) / ((s[b] + 1.0) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for key, text in docs:
        words, found = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found)
        out.append([key, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[3 + 1], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


ROWS = [(i, " ".join(f"word{(i * j) % 37} Étude{j % 5}_x" for j in range(i % 60))) for i in range(400)] + [(1000, None), (1001, ""), (1002, "A-b " * 300_000), (None, "no key " * 30)]
AIM = [(i, f"word{i} étude word5 b") for i in range(20)] + [(99, None)]


def test_against_words(spark):
    docs, target = spark.createDataFrame(ROWS, "doc_id long, text string"), spark.createDataFrame(AIM, "item_id long, text string")
    for longest in (1, 3):
        made = resample.draw(resample.score(docs, resample.gains(docs, target, longest=longest), longest=longest).drop("text"))
        assert sorted((tuple(r) for r in made.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr) == expected(ROWS, AIM, longest)
    report = resample.report(docs, target)
    assert [f.dataType.simpleString() for f in report.schema] == ["bigint"] * 5
    assert sorted((tuple(r) for r in report.collect()), key=repr) == sorted(((a, c, d, e, f) for a, _, c, d, e, f in expected(ROWS, AIM)), key=repr)


def test_blocks_keep_runs_whole(monkeypatch):
    text = b" ".join(b"w%d" % (i % 11) for i in range(500))
    whole = Counter(h for _, found in resample.runs(text, 4) for h in found)
    monkeypatch.setattr(resample, "BLOCK", 7)
    parts = list(resample.runs(text, 4))
    assert len(parts) > 50 and Counter(h for _, found in parts for h in found) == whole
    assert whole == Counter(zlib.crc32(f.encode()) for f in features(text.decode(), 4)[1])


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, score string").withColumnRenamed("score", "weight")
    target = spark.createDataFrame(AIM, "item_id long, text string")
    drawn = resample.resample(docs, target)
    assert drawn.columns == docs.columns and {r.weight for r in drawn.collect()} == {"x"}
    assert {r.doc_id for r in drawn.collect()} == {r[0] for r in expected(ROWS, AIM) if r[5]}


def test_empty_tables(spark):
    docs, target = spark.createDataFrame(ROWS[:40], "doc_id long, text string"), spark.createDataFrame(AIM, "item_id long, text string")
    assert resample.report(docs.limit(0), target).count() == 0
    found = resample.report(docs, target.limit(0)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted(((a, c, d, e, f) for a, _, c, d, e, f in expected(ROWS[:40], [])), key=repr)


def test_numbers_over_ranges(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(1000)] + [(3, None)] * 5, "k long, rank long")
    found = ranks.number_all(df.withColumnRenamed("rank", "v"), [F.col("k").desc(), F.col("v").asc_nulls_last()], "rank", part_rows=50).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 1006))
    keys = [(-r.k, r.v is None, r.v or 0) for r in sorted(found, key=lambda r: r["rank"])]
    assert keys == sorted(keys)
