"""Query of problem 2: the history of every document's listed name and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tavla.operators.history import versions
from tavla.session import table

STAMP = "yyyy-MM-dd HH:mm:ss"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, valid_from, valid_to of every version seen in document_snapshots."""
    history = versions(
        table(spark, sf_dir, "document_snapshots"),
        entity="document_id",
        ts="snapshot_ts",
        ingested="ingested_at",
        tie=["snapshot_id"],
        attributes=["appendix_name", "marketing_start_date", "marketing_end_date"],
        text_attributes=["appendix_name"],
        present=F.col("record_state") == "listed",
        observed=F.col("record_state").isin("listed", "withdrawn"),
    )
    return history.select(
        "document_id",
        F.date_format("valid_from", STAMP).alias("valid_from"),
        F.coalesce(F.date_format("valid_to", STAMP), F.lit("")).alias("valid_to"),
    )


P2_SQL = r"""
WITH held AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, snapshot_ts ORDER BY ingested_at DESC NULLS LAST, snapshot_id DESC) AS rn
  FROM document_snapshots WHERE document_id IS NOT NULL AND snapshot_ts IS NOT NULL
), seen AS (
  SELECT document_id, snapshot_ts, record_state = 'listed' AS listed,
    trim(regexp_replace(regexp_replace(appendix_name, '[\x{200e}\x{200f}\x{061c}\x{202a}-\x{202e}\x{2066}-\x{2069}]', '', 'g'),
      '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS nm,
    marketing_start_date AS ms, marketing_end_date AS me
  FROM held WHERE rn = 1 AND record_state IN ('listed', 'withdrawn')
), marked AS (
  SELECT *, lag(listed) OVER w AS p_listed, lag(nm) OVER w AS p_nm, lag(ms) OVER w AS p_ms, lag(me) OVER w AS p_me, row_number() OVER w AS pos
  FROM seen WINDOW w AS (PARTITION BY document_id ORDER BY snapshot_ts)
), points AS (
  SELECT document_id, snapshot_ts, listed, lead(snapshot_ts) OVER (PARTITION BY document_id ORDER BY snapshot_ts) AS nxt
  FROM marked
  WHERE pos = 1 OR listed <> p_listed
     OR (listed AND (nm IS DISTINCT FROM p_nm OR ms IS DISTINCT FROM p_ms OR me IS DISTINCT FROM p_me))
)
SELECT document_id, strftime(snapshot_ts, '%Y-%m-%d %H:%M:%S') AS valid_from,
  coalesce(strftime(nxt, '%Y-%m-%d %H:%M:%S'), '') AS valid_to
FROM points WHERE listed
"""

QUERIES = {"p2_found": p2_found}
ORACLES = {"p2_found": P2_SQL}
