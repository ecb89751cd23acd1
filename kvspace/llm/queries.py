"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvspace.llm import decontam, fim, html, neardup, ogg, packing, pii, quality, resample, sharding, suffixes, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_table(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.manifest(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_decontaminate, op3_html_text, op4_warc, op5_ogg, op6_pii, op7_packing, op8_near_duplicates, op9_jump_shards, op10_url_filter, op11_fill_in_middle, op12_suffix_dedup, op13_importance_resampling)
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CANONICAL = "CASE WHEN host <> '' THEN regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)$', ''), '^www\\.', '') || regexp_replace(path, '/+$', '') END"
_RULES = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [(k, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for k, h, p in _RULES]

# crc32 by bytes: a table of 256 steps, then one step for each byte of a word.
_CRC = """
steps AS (
  SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS step FROM range(256) AS r(i)),
crc AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode(w)) + 1), lambda k: CAST('0x' || substr(hex(encode(w)), 2 * k - 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, step[xor(c & 255, b) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT w FROM (SELECT unnest(w) AS w FROM own UNION ALL SELECT unnest(w) AS w FROM aim)), steps)"""

ORACLE_SQL: dict[str, str] = {
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS s, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, s, length(s) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substring(s, 1, a) AS prefix, substring(s, a + 1, b - a) AS middle, substring(s, b + 1, n - b) AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(s) AS restored_sha256
FROM parts""",
    "op12_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, doc_id, j, length(h) // 2 AS n, substr(h, 1024 * j + 1, 1122) AS h FROM (SELECT *, unnest(range(0, (length(h) + 1023) // 1024)) AS j FROM d)),
b AS (
  SELECT r, doc_id, 512 * j + k AS i, substr(h, 2 * k - 1, 2) AS byte, CASE WHEN 512 * j + k + 49 <= n THEN substr(h, 2 * k - 1, 100) END AS s
  FROM (SELECT *, unnest(range(1, least(512, n - 512 * j) + 1)) AS k FROM c)),
least_of AS (SELECT s, min(doc_id) AS least FROM b WHERE s IS NOT NULL GROUP BY s),
hits AS (SELECT r, doc_id, i, byte, doc_id > least AS hit FROM b LEFT JOIN least_of USING (s)),
marks AS (SELECT r, i, byte, coalesce(bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM hits),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM marks),
told AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM edges GROUP BY r)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN told USING (r)""",
    "op13_importance_resampling": f"""
WITH own AS (SELECT doc_id, {_WORDS} AS w FROM documents), aim AS (SELECT {_WORDS} AS w FROM benchmark),{_CRC},
s AS (SELECT crc % 10000 AS bucket, count(*) AS s FROM (SELECT unnest(w) AS w FROM own) JOIN crc USING (w) GROUP BY 1),
t AS (SELECT crc % 10000 AS bucket, count(*) AS t FROM (SELECT unnest(w) AS w FROM aim) JOIN crc USING (w) GROUP BY 1),
gain AS (
  SELECT w, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT CAST(sum(s) AS DOUBLE) FROM s) + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * ((SELECT CAST(sum(t) AS DOUBLE) FROM t) + 10000)))) AS BIGINT) AS gain
  FROM crc LEFT JOIN s ON s.bucket = crc % 10000 LEFT JOIN t ON t.bucket = crc % 10000),
weight AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM (SELECT doc_id, unnest(w) AS w FROM own) JOIN gain USING (w) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM own LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT CAST(doc_id AS BIGINT) AS doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank
FROM ranked""",
    "op2_decontaminate": f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
known AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM known),
own AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, own.n, item FROM own JOIN known ON own.n = known.n AND own.g = known.g),
marks AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN marks USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM m""",
    "op10_url_filter": f"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, {_CANONICAL} AS canonical FROM u),
l AS (SELECT canonical FROM c WHERE canonical IS NOT NULL GROUP BY canonical HAVING count(*) > 1)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {fits} THEN '{text}'" for _, text, fits in _FITS)} END AS rule,
  CASE {' '.join(f"WHEN {fits} THEN '{kind}'" for kind, _, fits in _FITS)} WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN l ON c.canonical = l.canonical""",
}
