"""Queries of the orphan-reference operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from kumiki.operators.orphans import bank_orphans
from kumiki.session import table


def _orphans(spark, d):
    return bank_orphans(*(table(spark, d, t) for t in ("bank", "passages", "exams", "aliases")))


def p1_found(spark, d):
    return _orphans(spark, d).select("tab", "rec_id", F.col("key").alias("ref_id")).distinct()


def p1_found_swept(spark, d):
    """The same where no list of intervals may be broadcast and a thousandth of the rows makes a key heavy."""
    o = bank_orphans(*(table(spark, d, t) for t in ("bank", "passages", "exams", "aliases")), heavy_share=0.001, broadcast_rows=0)
    return o.select("tab", "rec_id", F.col("key").alias("ref_id")).distinct()


def p1_counts(spark, d):
    """Orphan references per table and month of built_at; each writing row counts."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return _orphans(spark, d).groupBy("tab", month).agg(F.sum("n").cast("long").alias("n_refs"), F.countDistinct("key").alias("n_keys"))


_CTE = r"""
WITH refs AS (
  SELECT 'bank' AS tab, id AS rec_id, passage_id AS k, built_at AS t FROM bank
  UNION ALL
  SELECT 'exams', id, unnest(ids), built_at FROM (SELECT id, built_at, unnest(map_values(parts)) AS ids FROM exams)
), q AS (
  SELECT id AS k, built_at AS b, removed_at AS e FROM bank
  UNION ALL
  SELECT old_id, built_at, removed_at FROM aliases JOIN bank ON bank.id = kept_id
), lost AS (
  SELECT * FROM refs r WHERE regexp_matches(k, '[^\s\x{a0}\x{3000}]') AND CASE WHEN tab = 'bank'
    THEN NOT EXISTS (SELECT 1 FROM passages p WHERE p.pid = r.k AND p.added_at <= r.t AND (p.deleted_at IS NULL OR p.deleted_at > r.t))
    ELSE NOT EXISTS (SELECT 1 FROM q WHERE q.k = r.k AND q.b <= r.t AND (q.e IS NULL OR q.e > r.t)) END
)"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_found_swept": p1_found_swept}
ORACLES = {
    "p1_found": _CTE + " SELECT DISTINCT tab, rec_id, k AS ref_id FROM lost",
    "p1_found_swept": _CTE + " SELECT DISTINCT tab, rec_id, k AS ref_id FROM lost",
    "p1_counts": _CTE
    + " SELECT tab, strftime(t, '%Y-%m') AS month, count(*) AS n_refs, count(DISTINCT k) AS n_keys FROM lost GROUP BY ALL",
}
