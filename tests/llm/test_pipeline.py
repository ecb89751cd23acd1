"""The pipeline: stages, their columns, and planted cases."""

from __future__ import annotations

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_columns_and_rows(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for out in stages[:-1]:
        assert out.columns == docs.columns
    counts = [docs.count(), *(s.count() for s in stages[:-1])]
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    assert counts[3] == counts[4]  # redaction drops nothing


def test_decisions_take_effect(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0].collect()}
    assert sum(labels[i] == 0 for i in kept if i in labels) <= 2
    texts = [r.text for r in stages[1].collect()]
    assert len(set(texts)) == len(texts)
    assert not any("@" in r.text and ".example" in r.text for r in stages[3].collect())
    assert {r.doc_id for r in stages[4].select("doc_id").distinct().collect()} == {r.doc_id for r in stages[3].collect()}


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1].count()
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "MinHash near-dedup"


def test_stages_against_their_operators(spark, stages):
    """What each stage keeps or writes, from what its operator reports of the stage's own input."""
    from kvspace.llm import decontam, neardup, packing, pii, quality
    from kvspace.llm.queries import table, tokenizer_path

    docs = table(spark, SF, "documents")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(stages[0]) == ids(quality.score_documents(docs, table(spark, SF, "labels")).filter("score >= 0.3"))
    classes = neardup.near_duplicates(stages[0].select(*docs.columns)).collect()
    assert ids(stages[1]) == sorted({r.class_id for r in classes})
    assert ids(stages[2]) == ids(decontam.report(stages[1].select(*docs.columns), table(spark, SF, "benchmark")).filter("NOT contaminated"))
    before = {r.doc_id: r.text for r in stages[2].collect()}
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.report(stages[2].select(*docs.columns)).collect()}
    ranks = {k: i for i, k in enumerate(pii.KINDS)}
    changed = 0
    for r in stages[3].collect():
        out, at = "", 0
        for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in spans[r.doc_id]), key=lambda s: (s[1], -s[2], ranks[s[0]])):
            if a >= at:
                out += before[r.doc_id][at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        changed += bool(spans[r.doc_id])
        assert r.text == out + (before[r.doc_id] or "")[at:]
    assert changed
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    sizes = {i: len(b) // 4 + 1 for i, b in zip(texts, packing.token_bytes(list(texts.values()), tokenizer_path()), strict=True)}
    pieces = {}
    for r in stages[4].collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == sizes
