"""Queries of the general data-processing operators, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import intervals, orphans
from scriptorium.session import ready, table


def references(spark: SparkSession, sf_dir: str) -> list[orphans.Reference]:
    """The three references of the study tables."""
    jobs, notes, spans, pages, verses, translations, gone = (table(spark, sf_dir, t) for t in ("jobs", "notes", "spans", "pages", "verses", "translations", "tombstones"))
    c = F.col
    verse_key = F.concat_ws(":", c("translation_id").cast("string"), c("verse_id"))
    return [
        orphans.Reference("jobs.note_id", jobs, c("note_id"), c("job_id"), c("updated_at"), c("created_at"), notes, c("note_id"), c("created_at"), gone.where("tbl = 'notes'"), c("key_id"), c("deleted_at")),
        orphans.Reference("spans.page_id", spans, c("page_id"), c("span_id"), c("created_at"), c("created_at"), pages, c("page_id"), c("created_at"), gone.where("tbl = 'pages'"), c("key_id"), c("deleted_at")),
        orphans.Reference("verses.translation_id", verses, c("translation_id"), verse_key, c("imported_at"), c("imported_at"), translations, c("id"), c("installed_at")),
    ]


def p4_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every failing reference with its key and the reason."""
    return orphans.orphans(references(ready(spark), sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_orphans(spark, sf_dir).select("ref_name", "period", "row_key")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing references per reference and period."""
    return orphans.orphan_report(p4_orphans(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps per recording and speaker, speakers as stored."""
    spans = table(ready(spark), sf_dir, "spans").where("start_s IS NOT NULL AND end_s IS NOT NULL AND end_s > start_s AND speaker IS NOT NULL")
    return intervals.periods_and_gaps(spans, ["doc_id", "speaker"], F.round(F.col("start_s") * 1000), F.round(F.col("end_s") * 1000))


_ORPHANS_SQL = """
WITH refs AS (
  SELECT 'jobs.note_id' AS ref_name, j.note_id AS key, CAST(j.job_id AS VARCHAR) AS row_key, j.updated_at AS own, strftime(j.created_at, '%Y-%m') AS period FROM jobs j
  UNION ALL SELECT 'spans.page_id', page_id, CAST(span_id AS VARCHAR), created_at, strftime(created_at, '%Y-%m') FROM spans
  UNION ALL SELECT 'verses.translation_id', translation_id, CAST(translation_id AS VARCHAR) || ':' || verse_id, imported_at, strftime(imported_at, '%Y-%m') FROM verses
), parents AS (
  SELECT 'jobs.note_id' AS ref_name, note_id AS key, min(created_at) AS created FROM notes GROUP BY note_id
  UNION ALL SELECT 'spans.page_id', page_id, min(created_at) FROM pages GROUP BY page_id
  UNION ALL SELECT 'verses.translation_id', id, min(installed_at) FROM translations GROUP BY id
), gone AS (
  SELECT DISTINCT CASE tbl WHEN 'notes' THEN 'jobs.note_id' ELSE 'spans.page_id' END AS ref_name, key_id AS key FROM tombstones WHERE tbl IN ('notes', 'pages')
), found AS (
  SELECT DISTINCT r.ref_name, r.period, r.row_key, CAST(r.key AS BIGINT) AS key,
    CASE WHEN g.key IS NOT NULL THEN 'deleted' WHEN p.key IS NULL THEN 'missing' ELSE 'late' END AS reason
  FROM refs r LEFT JOIN parents p ON p.ref_name = r.ref_name AND p.key = r.key LEFT JOIN gone g ON g.ref_name = r.ref_name AND g.key = r.key
  WHERE r.key IS NOT NULL AND (g.key IS NOT NULL OR p.key IS NULL OR p.created > r.own)
)
"""

_P6_SQL = """
WITH s AS (
  SELECT DISTINCT doc_id, speaker, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b FROM spans
  WHERE speaker IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL AND end_s > start_s
), m AS (
  SELECT *, max(b) OVER (PARTITION BY doc_id, speaker ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s
), n AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, speaker ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m
)
SELECT doc_id, speaker, 'period' AS kind, min(a) AS start_ms, max(b) AS end_ms FROM n GROUP BY doc_id, speaker, island
UNION ALL SELECT doc_id, speaker, 'gap', reach, a FROM m WHERE a > reach
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p4_orphans": p4_orphans, "p4_report": p4_report, "p6_found": p6_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _ORPHANS_SQL + "SELECT ref_name, period, row_key FROM found",
        "p4_orphans": _ORPHANS_SQL + "SELECT ref_name, period, row_key, key, reason FROM found",
        "p4_report": _ORPHANS_SQL + "SELECT ref_name, period, count(*) FILTER (reason = 'missing') AS missing, count(*) FILTER (reason = 'deleted') AS deleted, count(*) FILTER (reason = 'late') AS late FROM found GROUP BY ref_name, period",
        "p6_found": _P6_SQL,
    }
