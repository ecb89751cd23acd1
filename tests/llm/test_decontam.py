"""Decontamination against a brute-force search."""

from __future__ import annotations

import hashlib
import re

from kvspace.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}
ITEM = "One two three four FIVE six seven eight nine ten eleven twelve"


def split(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(text, items):
    words, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


DOCS = [
    (1, f"before {ITEM.lower()} after"), (2, "one two three four five six seven eight nine"), (3, "x é-CASE short item y"), (4, None), (5, ""), (5, ""),
    (6, "a " * 20_000 + ITEM + " z " * 3), (7, "one two three four five six seven eight nine ten. One two three!"), (8, "…!?"), (9, "is is is is is is is is is is is is"),
]
ITEMS = [(10, ITEM), (2, "É-case short ITEM"), (3, "é-case SHORT item"), (4, None), (5, ""), (9, "is is is is is is is is is is is")]


def table(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_report(spark):
    docs, items = table(spark)
    expected = sorted((i, *brute(t, ITEMS)) for i, t in DOCS)
    assert sorted(tuple(r)[:6] for r in decontam.report(docs, items).collect()) == expected


def test_blocks_give_the_same(spark):
    docs, items = table(spark)
    one = decontam.find(docs, items).select("doc_id", "found").collect()
    many = decontam.find(docs, items, max_windows=2).select("doc_id", "found").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_modes_and_clashing_columns(spark):
    docs, items = table(spark)
    docs = docs.selectExpr("doc_id", "text", "'keep' AS hits", "1 AS n_words", "2 AS found", "3 AS _found")
    clean = {r.doc_id for r in decontam.decontaminate(docs, items).collect()}
    assert clean == {i for i, t in DOCS if not brute(t, ITEMS)[4]}
    cut = {r.doc_id: r for r in decontam.decontaminate(docs, items, "spans").collect()}
    assert cut[1].text == "before \n after" and (cut[1].hits, cut[1].found, cut[1]._found) == ("keep", 2, 3)
    assert cut[3].text == "x \n y" and cut[4].text is None


def test_empty_tables(spark):
    docs, items = table(spark)
    assert decontam.report(docs.limit(0), items).count() == 0
    assert decontam.report(docs, items.limit(0)).filter("contaminated").count() == 0
