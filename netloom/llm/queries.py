"""The queries of the corpus operators, and SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, decontaminate, divergence, html, lines, mixing, ngram_join, packing, quality, resampling, rules, tokens, toxicity
from .encode import word_tokenizer
from .text import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokens.write_tokens(read(spark, sf_dir, "documents"), word_tokenizer(), end_id=2)
    return tokens.read_tokens(spark, folder, with_ids=False)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(read(spark, sf_dir, "documents"), count_links=False)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(read(spark, sf_dir, "documents"), least_chars=1)
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("chance")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attribution.token_counts(read(spark, sf_dir, "documents"), attribution.head_body_tail(), word_tokenizer())
    named = [F.col("counts")[i].alias(name) for i, name in enumerate(("head_tokens", "body_tokens", "tail_tokens"))]
    return found.select("doc_id", "n_tokens", *named, "n_outside", "n_crossing")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), word_tokenizer(), capacity=4096, end_id=1)


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(read(spark, sf_dir, "documents"), (3, 1, 2), percent=150, most=2)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), least_docs=10, top=10)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_decontamination": f"""
WITH items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(list_slice(w, pos, pos + least(10, len(w)) - 1), ' ') AS win
  FROM items, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(pos) WHERE len(w) > 0),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS win FROM docs, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(pos)),
hits AS (SELECT doc_id, g.n, pos, item FROM grams g JOIN wins USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT pos + k) AS n_hit FROM hits, unnest(generate_series(0, n - 1)) AS t(k) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op3_ngram_jaccard_join": f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + least(5, len(w)) - 1), ' ') AS g
  FROM docs, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS t(pos) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM sizes s WHERE s.doc_id = a.doc_id) + (SELECT n FROM sizes s WHERE s.doc_id = b.doc_id) - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)""",
    "op11_source_mixing": f"""
WITH docs AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM docs GROUP BY source),
sums AS (
  SELECT *, sum(source_size) OVER () AS s, sum(weight) OVER () AS w, coalesce(sum(source_size) OVER before, 0) AS s0, coalesce(sum(weight) OVER before, 0) AS w0
  FROM sources WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT *, (150 * s - 200 * s0) * weight > 200 * source_size * (w - w0) AS over FROM sums),
plan AS (
  SELECT source, source_size, CASE WHEN over THEN CAST(2 * source_size AS DOUBLE) ELSE
    CAST((150 * s - 200 * coalesce(sum(source_size) FILTER (over) OVER (), 0)) * weight AS DOUBLE) / CAST(100 * sum(weight) FILTER (NOT over) OVER () AS DOUBLE) END AS target
  FROM cut),
each AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * {mixing.UNIT}) AS BIGINT) ELSE 0 END AS each,
    CAST('0x' || substr(sha256('11:' || coalesce(source, '')), 1, 6) AS BIGINT) AS start
  FROM plan),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM docs)
SELECT doc_id, size, source_size, target, ((place * each + start) // {mixing.UNIT} - ((place - 1) * each + start) // {mixing.UNIT}) * size AS taken
FROM ranked r JOIN each e ON r.source IS NOT DISTINCT FROM e.source""",
    "op12_source_divergence": f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
terms AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = k.term),
shares AS (
  SELECT lang, source, term, n, 1 + (1000000000 * CAST(n + 2 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p,
    1 + (1000000000 * CAST(sum(n) OVER (PARTITION BY lang, term) + 2 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM cells JOIN terms USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
