"""Thin queries over the operators: whole tables in, the contract's columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import table
from driftline.llm.decontamination import benchmark_matches
from driftline.llm.html_extract import html_extract
from driftline.llm.lz_fingerprint import lz_fingerprint
from driftline.llm.mixing import mixing
from driftline.llm.quality_fm import quality_fm
from driftline.llm.secret_scan import secret_scan
from driftline.llm.simhash_dedup import simhash_near_dedup
from driftline.llm.subword_lm import lm_scores
from driftline.llm.token_counts import token_counts
from driftline.llm.url_filter import url_filter
from driftline.plans.lineage import spread

Query = Callable[[SparkSession, str], DataFrame]


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for operators that spend their time on texts: over all cores where its files make fewer tasks."""
    return spread(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_fm": lambda s, d: quality_fm(dealt(s, d, "documents"), table(s, d, "labels")),
        "op2_simhash_near_dedup": lambda s, d: simhash_near_dedup(dealt(s, d, "documents")),
        "op3_lz_fingerprint": lambda s, d: lz_fingerprint(dealt(s, d, "documents")),
        "op4_url_filter": lambda s, d: url_filter(table(s, d, "pages")),
        "op5_html_extract": lambda s, d: html_extract(dealt(s, d, "pages")),
        "op6_subword_lm": lambda s, d: lm_scores(dealt(s, d, "documents")),
        "op7_decontamination": lambda s, d: benchmark_matches(dealt(s, d, "documents"), table(s, d, "benchmark")),
        "op8_mixing": lambda s, d: mixing(table(s, d, "documents")),
        "op9_secret_scan": lambda s, d: secret_scan(table(s, d, "documents")),
        "op10_token_counts": lambda s, d: token_counts(dealt(s, d, "documents")),
    }


#: The rules, the seeds, and 150 rounds of both ranks. The other operators' hashes, parses, models and automata have no SQL form.
URL_FILTER = r"""
WITH RECURSIVE base AS (
  SELECT page_id, coalesce(html, '') AS html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
kinds AS (SELECT DISTINCT host, path FROM base),
fits AS (
  SELECT host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, verdict DESC, h, p) AS rn
  FROM kinds JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
ruled AS (SELECT b.*, f.rule, f.verdict FROM base b LEFT JOIN (SELECT * FROM fits WHERE rn = 1) f ON b.host = f.host AND b.path = f.path),
links AS (
  SELECT host AS src, translate(d, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)) AS d FROM base WHERE host <> '')),
counted AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY ALL),
edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM counted),
nodes AS (
  SELECT host, max(trusted) AS trusted, max(blocked) AS blocked FROM (
    SELECT host, CAST(avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) > 0.5 AS INTEGER) AS trusted, CAST(avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) > 0.5 AS INTEGER) AS blocked
    FROM ruled WHERE host <> '' GROUP BY host
    UNION ALL SELECT src, 0, 0 FROM edges UNION ALL SELECT dst, 0, 0 FROM edges) GROUP BY host),
total AS (SELECT greatest(1, sum(trusted)) AS seeds, count(*) AS n FROM nodes),
ranks AS (
  SELECT 0 AS k, host, trusted / seeds AS trust, CAST(blocked AS DOUBLE) AS distrust FROM nodes, total
  UNION ALL
  SELECT m.k + 1, host, 0.15 * trusted / seeds + 0.85 * t, CASE WHEN blocked = 1 THEN 1.0 ELSE 0.85 * d END
  FROM (SELECT max(k) AS k, host, sum(t) AS t, sum(d) AS d FROM (
      SELECT k, dst AS host, trust * share AS t, 0.0::DOUBLE AS d FROM ranks JOIN edges ON host = src
      UNION ALL SELECT k, src, 0.0, distrust * share FROM ranks JOIN edges ON host = dst
      UNION ALL SELECT k, host, 0.0, 0.0 FROM ranks) GROUP BY host) m JOIN nodes USING (host), total
  WHERE m.k < 150),
bad AS (SELECT host FROM ranks, total WHERE k = (SELECT max(k) FROM ranks) AND distrust >= 0.3 AND trust * n < 1)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": URL_FILTER}
