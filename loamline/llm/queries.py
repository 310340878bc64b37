"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, media, mixing, pii, quality, simhash, substrings, tokens, toxicity, urls
from .base import table

#: Fixed value: the rules of the URL query.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words("spans")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontaminate.items_digest("items").alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_copies(media.pictures(table(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The key of the registered query; a real run passes its own secret.
PII_KEY = b"registered query, not a secret"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"), PII_KEY)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_counts": op3_token_counts,
    "op4_url_filter": op4_url_filter,
    "op5_source_mix": op5_source_mix,
    "op6_toxicity": op6_toxicity,
    "op7_image_copies": op7_image_copies,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "pipeline": pipeline,
}

_WORDS = "string_split_regex(trim(regexp_replace(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')), ' ')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": f"""
WITH doc AS (SELECT doc_id, list_filter({_WORDS.format('text')}, lambda w: w <> '') AS ws FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter({_WORDS.format('text')}, lambda w: w <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(ws)) AS n, list_slice(ws, i, i + least(10, len(ws)) - 1) AS w
        FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM item WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS w
         FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, lens WHERE len(ws) >= n)),
hit AS (SELECT doc_id, spot.n, i, item FROM spot JOIN win ON spot.n = win.n AND spot.w = win.w),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
cnt AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cnt USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_url_filter": """
WITH RECURSIVE p AS (
  SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
best AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
node AS (SELECT page_id, host || CASE WHEN path = '' THEN '/' ELSE path END || regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\\??[^#]*)', 1) AS a, html FROM p WHERE host <> ''),
link AS (SELECT DISTINCT a, host || CASE WHEN path = '' THEN '/' ELSE path END AS b FROM (
  SELECT a, translate(regexp_extract(l, '^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(l, '^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM (SELECT a, regexp_extract(html, '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS l FROM node)) WHERE host <> ''),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
said AS (SELECT r.a, bool_or(v.verdict = 'allow') AS allowed, bool_or(v.verdict = 'block') AS blocked FROM reach r JOIN node n ON n.a = r.b JOIN best v ON v.page_id = n.page_id GROUP BY r.a)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN best ON best.page_id = p.page_id LEFT JOIN node ON node.page_id = p.page_id LEFT JOIN said ON said.a = node.a""",
    "op5_source_mix": """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(source_size * 3) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
        sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
c AS (SELECT *, source_size * 3 * free <= weight * (total - held) AS capped FROM f),
l AS (SELECT max(total - held) AS remaining, arg_max(free, total - held) AS free FROM c WHERE NOT capped),
t AS (SELECT c.source, source_size, CASE WHEN capped THEN CAST(source_size * 3 AS DOUBLE) ELSE CAST(weight * l.remaining AS DOUBLE) / CAST(l.free AS DOUBLE) END AS target FROM c, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 4294967296) AS BIGINT) ELSE 0 END AS step,
        CAST('0x' || substr(md5('42:' || coalesce('=' || source, 'null')), 1, 8) AS BIGINT) AS off FROM t),
r AS (SELECT d.doc_id, size, source_size, target, step, off, sum(CAST(step AS HUGEINT)) OVER (PARTITION BY d.source ORDER BY size, d.doc_id ROWS UNBOUNDED PRECEDING) + off AS p
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST((p // 4294967296 - (p - step) // 4294967296) * size AS BIGINT) AS taken FROM r""",
}
