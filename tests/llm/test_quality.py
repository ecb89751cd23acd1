"""The rule ensemble: held-out accuracy, rules, edge cases."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest

from kvspace.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 300_000), (-4, "\n\n"), (-4, "\n\n")], "doc_id long, text string")
    scored = quality.score_documents(docs.select("doc_id", "text").unionByName(odd).selectExpr("*", "'c' AS signs", "1 AS _t"), labels).collect()
    assert len(scored) == docs.count() + 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in scored if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    kept = quality.keep_good(docs.selectExpr("*", "2 AS digits"), labels)
    assert kept.columns == [*docs.columns, "digits"]
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in scored if r.predicted and r.doc_id >= 0}


def test_sparse_rules(tables):
    model = quality.fit(*tables)
    assert 0 < len(model.rules) < 80 and all(w for _, w in model.rules)


def test_labels_missing_or_of_one_class(spark, tables):
    docs, labels = tables
    assert quality.fit(docs, labels.limit(0)).rules == []
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert one.rules == [] and one.bias > 3
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    noisy = labels.selectExpr("doc_id", "cast(null as int) quality").unionByName(labels.select("doc_id", "quality"))
    assert quality.training_rows(docs, noisy).count() == quality.training_rows(docs, labels).count()


def statistics(text):
    """The statistics by their definition, one text at a time."""
    text = text or ""
    n = max(len(text), 1)
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    lines = [x for x in text.split("\n") if x]
    share = lambda signs: sum(c in signs for c in text) / n
    return {
        "log_chars": math.log1p(len(text)), "signs": share(quality._SIGNS), "bangs": share("!"), "bars": share("|"), "capitals": share(quality._CAPITALS), "digits": share("0123456789"), "breaks": share("\n"),
        "word_length": n / len(words) if words else 0.0, "variety": len(set(words)) / max(len(words), 1), "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1), "same_lines": 1 - len(set(lines)) / max(len(lines), 1),
    }


def test_scores_against_rules_one_by_one(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " " * 1000), (-4, "A a a\n\nA a a\n!|#")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    found = {r.doc_id: r.score for r in quality.score_documents(every, labels).collect()}
    for r in every.collect():
        own = statistics(r.text)
        held = lambda rule: all((own[quality.STATISTICS[f]] > v) if greater else (own[quality.STATISTICS[f]] <= v) for f, greater, v in rule)  # noqa: B023, E731
        total = model.bias + sum(w for rule, w in model.rules if held(rule))
        assert abs(found[r.doc_id] - 1 / (1 + math.exp(-total))) < 1e-9, r.doc_id


def test_texts_of_one_labelled_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c d"), (3, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels)
    assert rows.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2, 3))


def test_no_text_goes_to_the_gathering_task(spark, tables, monkeypatch):
    """The task that gathers all training rows gets numbers alone, however long the texts are."""
    monkeypatch.setattr(quality, "cut", lambda df: df)
    docs, labels = tables
    plan = quality.training_rows(docs, labels)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Aggregate":
        plan = plan.children().head()
    into = plan.children().head().output()
    names = [into.apply(i).name() for i in range(into.size())]
    assert set(quality.STATISTICS) <= set(names) and "text" not in names


def test_lasso_reaches_the_optimum():
    """The conditions of the least loss hold for every weight, with equal, opposite and constant columns too."""
    rng = np.random.default_rng(5)
    for n, k in ((400, 12), (3000, 60)):
        x = (rng.random((n, k)) < rng.random(k)).astype(float)
        y = (rng.random(n) < 1 / (1 + np.exp(2 - 3 * x[:, 0] + 2 * x[:, 1] - x[:, 2] * x[:, 3]))).astype(float)
        x = np.column_stack([x, x[:, 0], 1 - x[:, 0], np.ones(n), np.zeros(n)])
        bias, w = quality.lasso_logistic(x, y)
        slope = x.T @ (1 / (1 + np.exp(-(bias + x @ w))) - y) / n
        assert abs(np.mean(1 / (1 + np.exp(-(bias + x @ w))) - y)) < 1e-6
        on = w != 0
        assert on.any() and np.abs(slope[on] + quality.LASSO * np.sign(w[on])).max() < 1e-6 and np.abs(slope[~on]).max() <= quality.LASSO + 1e-6
        assert w[0] == w[k] == -w[k + 1] != 0 and w[k + 2] == w[k + 3] == 0


def test_fit_runs_few_jobs(spark, tables):
    """The regression is no job a step: each would leave broadcasts of some MB in the driver."""
    sc = spark.sparkContext
    sc.setJobGroup("quality-fit", "counted")
    try:
        quality.fit(*tables)
        assert len(sc.statusTracker().getJobIdsForGroup("quality-fit")) < 40
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
