"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, divergence, html_extract, jaccard, langid, mixing, packing, pii, quality, spelling, suffix, tokencount
from ._io import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced of every document."""
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows["vec_id"] % 100 == 0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, copy_of, n_copies, n_links, class_id, kept of every document."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every document."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated passages, n_words, n_removed, spans of every document."""
    return suffix.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extraction, op2_pii_pseudonyms, op3_language_id, op4_nearest_neighbours, op5_quality_rules, op6_best_fit_packing, op7_ngram_jaccard_join, op8_token_counts, op9_suffix_array_dedup, op10_bpe_round_trip, op11_spelling_variants, op12_source_divergence, op13_source_mixing)
    return {f.__name__: f for f in found}


#: All pairs of distinct shingle sets that share a shingle, and what they tie together.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM words
), classes AS MATERIALIZED (
  SELECT s, min(doc_id) AS rep, count(*) AS n, len(s) AS size FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS MATERIALIZED (
  SELECT rep, size, unnest(s) AS shingle FROM classes
), links AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9
), reach(rep, other) AS (
  SELECT rep, rep FROM classes UNION SELECT r.rep, l.b FROM reach r JOIN links l ON l.a = r.other
), roots AS (
  SELECT rep, min(other) AS class_id FROM reach GROUP BY rep
)
SELECT t.doc_id, coalesce(c.rep, t.doc_id) AS copy_of, coalesce(c.n, 1) AS n_copies, (SELECT count(*) FROM links l WHERE l.a = c.rep) AS n_links,
  coalesce(r.class_id, t.doc_id) AS class_id, coalesce(r.class_id, t.doc_id) = t.doc_id AS kept
FROM sets t LEFT JOIN classes c ON c.s = t.s AND len(t.s) > 0 LEFT JOIN roots r ON r.rep = c.rep
"""


#: All terms of a language by all its groups, and every pair of groups over them.
DIVERGENCE = r"""
WITH rows AS MATERIALIZED (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), counts AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM (SELECT lang, source, doc, unnest(terms) AS term FROM rows) GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL
), groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(sum(k.cn), 0) AS total FROM (SELECT DISTINCT lang, source FROM rows) g
  LEFT JOIN (SELECT c.lang, c.source, c.n AS cn FROM counts c JOIN kept k USING (lang, term)) k USING (lang, source) GROUP BY ALL
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + ((coalesce(c.n, 0) + 2)::HUGEINT * 1000000000 // (g.total + 2 * l.v)::HUGEINT)::BIGINT AS p, 1 + ((k.n + 2)::HUGEINT * 1000000000 // (l.total + 2 * l.v)::HUGEINT)::BIGINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found) WHERE part = 'pair' OR rank <= 10
"""

#: The same order by hash, summed from the start.
MIXING = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, n AS size, ('0x' || substr(md5('13|' || coalesce(doc_id::VARCHAR, '') || '|' || n), 1, 15))::BIGINT AS h
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n FROM documents)
), w AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size / w AS full_at, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS left_size, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w
  FROM w WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT left_size::DOUBLE AS left_size, left_w::DOUBLE AS left_w FROM f WHERE left_size::DOUBLE / left_w <= full_at ORDER BY full_at, source NULLS FIRST LIMIT 1
), t AS (
  SELECT source, source_size, least(w * l.left_size / l.left_w, (3 * source_size)::DOUBLE) AS target FROM f, l
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM t
), c AS (
  SELECT d.*, b.source_size, target, times, target - times * b.source_size AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, (size * (times + (budget > 0 AND (upto < budget OR upto - size < budget AND upto - budget <= budget - (upto - size)))::INT))::BIGINT AS taken FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_ngram_jaccard_join": NEAR_DUPLICATES, "op12_source_divergence": DIVERGENCE, "op13_source_mixing": MIXING}
