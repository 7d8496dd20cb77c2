"""Registered queries of the alert evaluation (E2): W1, A30-A34, O4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import alerting as A
from ..operators.dedup import latest_per_track
from . import common as Q
from .common import FAIL_SQL, alert_ctes


def _latest(spark: SparkSession, sf_dir: str, window: int = Q.WINDOW) -> DataFrame:
    return latest_per_track(Q.facts(spark, sf_dir), Q.ASOF, window)


def lines_above_threshold(spark, sf_dir, window=Q.WINDOW, threshold=Q.THRESHOLD):
    return A.line_rates(_latest(spark, sf_dir, window), Q.MIN_SAMPLES, threshold, Q.TOP_LINES)


def dedup_latest(spark, sf_dir):
    return _latest(spark, sf_dir)


def line_status(spark, sf_dir):
    return A.line_status(_latest(spark, sf_dir), Q.MIN_SAMPLES, Q.THRESHOLD)


def top_testcodes(spark, sf_dir):
    return A.top_codes(_latest(spark, sf_dir), Q.TOP_CODES)


def worst_station(spark, sf_dir):
    return A.worst_station(_latest(spark, sf_dir))


def window_diagnostics(spark, sf_dir):
    facts = Q.facts(spark, sf_dir)
    return A.diagnostics(facts, latest_per_track(facts, Q.ASOF, Q.WINDOW), Q.ASOF, Q.WINDOW)


def latest_rows(spark, sf_dir):
    return A.latest_rows(Q.facts(spark, sf_dir), Q.ASOF, Q.WINDOW, 5)


QUERIES = {
    "lines_above_threshold": lines_above_threshold,
    "dedup_latest": dedup_latest,
    "line_status": line_status,
    "top_testcodes": top_testcodes,
    "worst_station": worst_station,
    "window_diagnostics": window_diagnostics,
    "latest_rows": latest_rows,
}

_RATE = "failed * CAST(100.0 AS DOUBLE) / total"
_LINE_COUNTS = (f"SELECT line, COUNT(*) AS total, CAST(SUM(CASE WHEN {FAIL_SQL} THEN 1 ELSE 0 END) AS BIGINT) "
                "AS failed FROM latest GROUP BY line")


def lines_above_threshold_sql(window=Q.WINDOW, threshold=Q.THRESHOLD, min_samples=Q.MIN_SAMPLES,
                              k=Q.TOP_LINES, asof=Q.ASOF) -> str:
    return alert_ctes(asof, window) + f"""
SELECT line, total, failed, round_even({_RATE}, 2) AS rate
FROM ({_LINE_COUNTS})
WHERE total >= {min_samples} AND {_RATE} > {threshold}
ORDER BY {_RATE} DESC, line LIMIT {k}"""


ORACLES = {
    "lines_above_threshold": lines_above_threshold_sql(),
    "dedup_latest": alert_ctes() + "SELECT * FROM latest",
    "line_status": alert_ctes() + f"""
SELECT line, total, failed, round_even({_RATE}, 2) AS rate,
       round_even({_RATE}, 2) > {Q.THRESHOLD} AS above
FROM ({_LINE_COUNTS}) WHERE total >= {Q.MIN_SAMPLES}""",
    "top_testcodes": alert_ctes() + f"""
, per_code AS (
  SELECT line, TRIM(split_part(failed_testcode, ';', 1)) AS code, process, COUNT(*) AS failed_units
  FROM latest WHERE {FAIL_SQL} AND failed_testcode IS NOT NULL AND TRIM(failed_testcode) <> ''
  GROUP BY 1, 2, 3)
, ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY line ORDER BY failed_units DESC, code ASC NULLS LAST,
                                process ASC NULLS LAST) AS rank FROM per_code)
, totals AS (SELECT line, COUNT(*) AS total_line FROM latest GROUP BY line)
SELECT r.line, CAST(r.rank AS BIGINT) AS rank, COALESCE(NULLIF(r.code, ''), 'UNKNOWN') AS testcode,
       COALESCE(r.process, 'N/A') AS process, r.failed_units, t.total_line,
       round_even(CAST(r.failed_units AS DOUBLE) / t.total_line * 100, 1) AS rate
FROM ranked r JOIN totals t ON r.line IS NOT DISTINCT FROM t.line WHERE r.rank <= {Q.TOP_CODES}""",
    "worst_station": alert_ctes() + f"""
, per_station AS (SELECT line, station, COUNT(*) AS failed FROM latest WHERE {FAIL_SQL} GROUP BY 1, 2)
, best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY line ORDER BY failed DESC,
                                   station ASC NULLS LAST) AS rn FROM per_station) WHERE rn = 1)
, lines AS (SELECT DISTINCT line FROM latest)
SELECT l.line, CASE WHEN b.failed IS NULL THEN l.line ELSE b.station END AS station,
       CAST(COALESCE(b.failed, 0) AS BIGINT) AS failed
FROM lines l LEFT JOIN best b ON l.line IS NOT DISTINCT FROM b.line""",
    "window_diagnostics": alert_ctes() + f"""
SELECT (SELECT COUNT(*) FROM facts) AS total_rows,
       (SELECT COUNT(*) FROM facts WHERE event_ts IS NULL) AS unparsable_rows,
       (SELECT COUNT(*) FROM win) AS raw_rows,
       (SELECT COUNT(*) FROM win WHERE {FAIL_SQL}) AS raw_failures,
       (SELECT MIN(event_ts) FROM win) AS earliest,
       (SELECT MAX(event_ts) FROM win) AS latest,
       (SELECT COUNT(*) FROM latest) AS dedup_rows,
       (SELECT COUNT(*) FROM latest WHERE {FAIL_SQL}) AS dedup_failures""",
    "latest_rows": alert_ctes() + f"""
SELECT id, line, station, status, event_ts, event_ts >= TIMESTAMP '{Q.cutoff_text()}' AS in_window
FROM facts WHERE event_ts IS NOT NULL ORDER BY event_ts DESC, id DESC LIMIT 5""",
}
