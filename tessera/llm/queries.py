"""Registered queries of the dealt operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import (audit, decontaminate, jaccard, licenses, mtree, pack, quality, repeats, shards, urls, vptree,
                         whiten, wrappers)
from tessera.llm.common import table

def op1_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search_embeddings(table(spark, sf_dir, "embeddings"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(table(spark, sf_dir, "documents"), pack.tokenizer_path("word_bpe_49k.json"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_pages(table(spark, sf_dir, "pages")).drop("component")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup_documents(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten_embeddings(table(spark, sf_dir, "embeddings"))


def op12_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.search_embeddings(table(spark, sf_dir, "embeddings"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mtree_search, op2_best_fit_packing, op3_quality_classifier, op4_url_filters, op5_sharding,
              op6_license_scans, op7_ngram_jaccard_join, op8_html_extraction, op9_decontamination, op10_suffix_array_dedup,
              op11_embedding_whitening, op12_vantage_point_search, op13_filter_interaction_audit)
}

SQL: dict[str, str] = {}

SQL["op1_mtree_search"] = """
WITH base AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM base q JOIN base c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

SQL["op4_url_filters"] = r"""
WITH RECURSIVE split AS (
  SELECT page_id, url, html,
         CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, url, html,
         translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '(?s)^[^?#]*(\?[^#]*)?', 1) AS query
  FROM split
), ruled AS (
  SELECT *, CASE WHEN host = '' THEN NULL ELSE host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS vertex,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
), links AS (
  SELECT vertex AS u, unnest(regexp_extract_all(html, '(?is)<link\s[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')) AS tag
  FROM ruled WHERE vertex IS NOT NULL
), edges AS (
  SELECT u, regexp_replace(regexp_extract(tag, '(?i)href\s*=\s*["'']?[a-z]+://([^"''#>\s]+)', 1), '^[^/?]*$', '\0/') AS v FROM links
), linked AS (
  SELECT u, v FROM edges WHERE v <> '' UNION SELECT v, u FROM edges WHERE v <> ''
), reach(a, b) AS (
  SELECT u, u FROM linked UNION SELECT reach.a, linked.v FROM reach JOIN linked ON reach.b = linked.u
), rule_of AS (
  SELECT vertex, max(CASE WHEN rule IN ('org/', 'com/fr/') THEN 1 ELSE 0 END) AS allowed,
         max(CASE WHEN rule IN ('org/', 'com/fr/') THEN 0 ELSE 1 END) AS blocked
  FROM ruled WHERE rule IS NOT NULL AND vertex IS NOT NULL GROUP BY vertex
), shared AS (
  SELECT a AS vertex, CASE WHEN max(allowed) = 1 THEN 'allow' WHEN max(blocked) = 1 THEN 'block' ELSE 'allow' END AS verdict
  FROM reach JOIN rule_of ON reach.b = rule_of.vertex GROUP BY a
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            ELSE coalesce(shared.verdict, 'allow') END AS verdict
FROM ruled LEFT JOIN shared USING (vertex)
"""

SQL["op13_filter_interaction_audit"] = r"""
WITH marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id
), judged AS (
  SELECT coalesce(source, '') AS part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, coalesce(text, '') AS t,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM documents LEFT JOIN marks USING (doc_id)
), masks AS (
  SELECT part, good, toxic,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END AS fails
  FROM judged
), kinds AS (
  SELECT part, fails, count(*) AS c, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM masks GROUP BY part, fails
), parts AS (
  SELECT DISTINCT part FROM kinds
), subsets AS (
  SELECT part, s::INTEGER AS s, coalesce(sum(c) FILTER (fails & s = 0), 0) AS c, coalesce(sum(g) FILTER (fails & s = 0), 0) AS g,
         coalesce(sum(x) FILTER (fails & s = 0), 0) AS x
  FROM kinds, range(32) r(s) GROUP BY part, s
), filters(f, i) AS (
  VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)
), orders(filter_order) AS (
  SELECT a.f || b.f || c.f || d.f || e.f FROM filters a, filters b, filters c, filters d, filters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, f.i, sum(1 << p.i) FILTER (k < step) AS before
  FROM orders, range(1, 6) t(step), range(1, 6) u(k), filters f, filters p
  WHERE f.f = filter_order[step] AND p.f = filter_order[k] GROUP BY filter_order, step, f.i
), lines AS (
  SELECT part, filter_order, step, i, b.c - a.c AS removed, a.c AS kept, b.g - a.g AS good_lost, b.x - a.x AS toxic_lost
  FROM steps JOIN subsets b ON b.s = coalesce(before, 0) JOIN subsets a USING (part)
  WHERE a.s = coalesce(before, 0) + (1 << i)
), alone AS (
  SELECT part, i, coalesce(sum(c) FILTER (fails & (1 << i) <> 0), 0) AS failing,
         coalesce(sum(c) FILTER (fails = 1 << i), 0) AS unique_fails FROM kinds, filters GROUP BY part, i
), shares AS (
  SELECT part, i, sum(removed) AS shapley FROM lines GROUP BY part, i
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       (failing - removed)::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM lines JOIN alone USING (part, i) JOIN shares USING (part, i)
"""
