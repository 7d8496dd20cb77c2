"""Registered queries of the three dashboards (E3): filters and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as K
from ..operators import filters as FL
from ..operators import reports as R
from ..operators.prepare import prepare
from ..session import scratch
from ..sources.files import read_facts, write_facts
from . import common as Q
from .common import dash_ctes


def view(spark, sf_dir, profile="tests", spec: FL.FilterSpec | None = None):
    """load -> prepare -> filter (the default filter keeps all non-null dims)."""
    spec = spec or FL.FilterSpec(profile=profile)
    return spec.apply(prepare(Q.facts(spark, sf_dir), profile))


# --- A1-A16, A22, A26, W2, W3 -------------------------------------------------
def _q(fn, profile="tests"):
    return lambda spark, sf_dir: fn(view(spark, sf_dir, profile))


def _kpis(spark, sf_dir):
    prep = prepare(Q.facts(spark, sf_dir), "tests")
    return R.test_kpis(prep, FL.FilterSpec().predicate())


def _mapped(spark, sf_dir):
    # An input whose columns go by other names
    facts = Q.facts(spark, sf_dir).withColumnsRenamed({v: k for k, v in _MAPPING.items()})
    return R.status_counts(prepare(facts, "tests", _MAPPING), "process")


_MAPPING = {"unit": "track_id", "tester": "station", "result": "status", "product": "model", "stage": "process"}
# values that get a column each in the wide matrices
_LINES = [f"L{k}" for k in range(5)]
_PROCESSES = ["DepthCal", "DepthVal", "FOD", "L2AR", "L2VISION", "MANUAL", "UCT"]
_ONE_DAY = FL.FilterSpec(start_date="2024-01-15", end_date="2024-01-15")

QUERIES = {
    "counts_by_process": _q(lambda d: R.status_counts(d, "process")),
    "counts_by_model": _q(lambda d: R.status_counts(d, "model")),
    "counts_by_line": _q(lambda d: R.status_counts(d, "line")),
    "test_kpis": _kpis,
    "failrate_model_line": _q(lambda d: R.fail_matrix(d, "model", "line")),
    "failrate_model_process": _q(lambda d: R.fail_matrix(d, "model", "process")),
    "model_process_league": _q(lambda d: R.league(d, 15)),
    "failed_tracks_model_process": _q(R.distinct_failed_tracks),
    "pareto_codes": _q(lambda d: R.pareto(d, 20, blank_code=False, places=1)),
    "pareto_codes_missing": _q(lambda d: R.pareto(d, 15, blank_code=True, places=None), "span"),
    "code_detail": _q(lambda d: R.code_detail(d, 20)),
    "failures_by_process": _q(R.failures_by_process),
    "failure_hierarchy": _q(R.hierarchy),
    "hourly_volume": _q(lambda d: R.hourly(d, [K.PASSED, K.FAILED]), "span"),
    "daily_trend": _q(R.daily),
    "minute_trend": lambda s, d: R.by_minute(view(s, d, "tests", _ONE_DAY)),
    "failrate_by_hour": _q(R.fail_rate_by_hour),
    "station_stats": _q(R.station_stats),
    "station_stats_pattern": _q(lambda d: R.station_stats(d, "pattern"), "pattern"),
    "station_top15_long": _q(lambda d: R.station_top_long(d, [K.PASSED, K.FAILED], R.tests_label(), 15)),
    "station_top15_pattern": _q(lambda d: R.station_top_long(d, [K.PASSED, K.NTF, K.REAL_FAIL], None, 15),
                                "pattern"),
    "realfail_model_line_tests": _q(lambda d: R.fail_matrix(
        d, "model", "line", F.col("status_display") == K.REAL_FAIL, 1), "pattern"),
    "failure_type_split": _q(R.failure_types, "pattern"),
    "top3_codes_per_model": _q(lambda d: R.top_codes_per_model(d, 3), "span"),
    "station_stats_span": _q(lambda d: R.station_stats(d, "span"), "span"),
    "hourly_volume_classes": _q(lambda d: R.hourly(d, [K.PASSED, K.NTF, K.REAL_FAIL]), "pattern"),
    "pareto_codes_pattern": _q(lambda d: R.pareto(d, 15, blank_code=True, places=None), "pattern"),
    "code_detail_pattern": _q(lambda d: R.code_detail(d, 10, blank_code=True), "pattern"),
    "failure_hierarchy_pattern": _q(R.hierarchy, "pattern"),
    "failrate_model_line_wide": _q(lambda d: R.fail_matrix(d, "model", "line", columns=_LINES)),
    "failed_tracks_model_process_wide": _q(lambda d: R.distinct_failed_tracks(d, _PROCESSES)),
    "mapped_columns": _mapped,
}

# --- F1-F6, F11, S9 -----------------------------------------------------------
_ROW_COLS = ["id", "track_id", "model", "line", "station", "process", "status",
             "failed_testcode", "event_ts", "status_display"]

_DIMS_SPEC = FL.FilterSpec(start_date="2024-01-05", end_date="2024-01-20",
                           start_time="06:00", end_time="18:30",
                           line=["L0", "L2", "L3"], process=["L2AR", "UCT", "FOD", "MANUAL"])


def _rows(profile, spec):
    return lambda s, d: view(s, d, profile, spec).select(*_ROW_COLS)


def _stored_rows(profile, spec):
    """The filter on stored facts: folders and row groups that it cannot hold are not read."""
    def run(s, d):
        path = f"{scratch(s)}/facts"
        write_facts(Q.facts(s, d), path)
        return spec.apply(prepare(read_facts(s, path), profile)).select(*_ROW_COLS)
    return run


def _shifts(spark, sf_dir):
    d = view(spark, sf_dir, "tests")
    return d.agg(*[F.count_if(FL.FilterSpec(shift=name).predicate()).cast("long").alias(name.lower())
                   for name in K.SHIFT_PRESETS])


QUERIES.update({
    "filter_date_time_dims": _rows("tests", _DIMS_SPEC),
    "filter_stored_facts": _stored_rows("tests", _DIMS_SPEC),
    "shift_presets": _shifts,
    "search_rows": _rows("tests", FL.FilterSpec(search="wifi")),
    "search_rows_all_columns": _rows("span", FL.FilterSpec(profile="span", search="l4_st1|2024-01-07")),
    "status_filter": _rows("pattern", FL.FilterSpec(profile="pattern", status=K.NTF)),
    "status_filter_failed": _rows("tests", FL.FilterSpec(status=K.FAILED)),
    "filter_domains": lambda s, d: FL.domains(view(s, d, "tests")),
    "filter_summary": lambda s, d: FL.summary(prepare(Q.facts(s, d), "tests")),
    "export_rows": lambda s, d: R.export_frame(
        view(s, d, "tests"), ["timestamp", "track_id", "model", "line", "station", "process",
                              "status_display", "failed_testcode"]),
})


# ---------------------------------------------------------------------------
# DuckDB twins
# ---------------------------------------------------------------------------
def _pct(part, total, places):
    raw = f"COALESCE(CAST({part} AS DOUBLE) / NULLIF({total}, 0) * 100, 0.0)"
    return raw if places is None else f"round_even({raw}, {places})"


def _status_counts_sql(dim):
    return dash_ctes("tests") + f"""
SELECT {dim}, status_display AS status, COUNT(*) AS count FROM filt WHERE {dim} IS NOT NULL GROUP BY 1, 2"""


def _matrix_sql(profile, row, col, cond="failed", places=1):
    return dash_ctes(profile) + f"""
SELECT {row}, {col}, total, fails, {_pct('fails', 'total', places)} AS fail_pct FROM (
  SELECT {row}, {col}, COUNT(*) AS total, COUNT(*) FILTER (WHERE {cond}) AS fails
  FROM filt WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY 1, 2)"""


def _running(places):
    order = "ORDER BY count DESC, code"
    raw = (f"CAST(SUM(count) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)"
           f" / SUM(count) OVER () * 100")
    cum = raw if places is None else f"round_even({raw}, {places})"
    return f"CAST(ROW_NUMBER() OVER ({order}) AS BIGINT) AS rank, {cum} AS cum_pct"


def _pareto_sql(profile, k, blank, places):
    cond = "failed" if blank else "failed AND failed_testcode <> ''"
    return dash_ctes(profile) + f"""
, top AS (SELECT failed_testcode AS code, COUNT(*) AS count FROM filt WHERE {cond}
          GROUP BY 1 ORDER BY count DESC, code LIMIT {k})
SELECT code, count, {_running(places)} FROM top"""


def _station_top_sql(profile, statuses, label):
    cols = ", ".join(f"COUNT(*) FILTER (WHERE lbl = '{s}') AS \"{s}\"" for s in statuses)
    total = " + ".join(f'"{s}"' for s in statuses)
    parts = " UNION ALL ".join(f"SELECT station, total, '{s}' AS status, \"{s}\" AS count FROM top"
                               for s in statuses)
    return dash_ctes(profile) + f"""
, wide AS (SELECT station, {cols} FROM (SELECT *, {label} AS lbl FROM filt)
           WHERE station IS NOT NULL GROUP BY station)
, top AS (SELECT *, {total} AS total FROM wide ORDER BY total DESC, station LIMIT 15)
{parts}"""


def _grid_sql(profile, statuses):
    labels = ", ".join(f"('{s}')" for s in statuses)
    return dash_ctes(profile) + f"""
, counts AS (SELECT hour, status_display AS status, COUNT(*) AS count FROM filt GROUP BY 1, 2)
, grid AS (SELECT h.range AS hour, s.status FROM range(24) h, (VALUES {labels}) s(status))
SELECT g.hour, g.status, CAST(COALESCE(c.count, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN counts c ON g.hour = c.hour AND g.status = c.status"""


def _detail_sql(profile, k, cond):
    return dash_ctes(profile) + detail_sql(k, cond)


def detail_sql(k, cond):
    return f"""
, codes AS (SELECT failed_testcode AS code, COUNT(*) AS count, arg_min_null(track_id, id) AS example_track
            FROM filt WHERE {cond} GROUP BY 1)
, top AS (SELECT * FROM codes ORDER BY count DESC, code LIMIT {k})
SELECT code, count, {_pct('count', '(SELECT SUM(count) FROM codes)', 1)} AS pct_of_failures,
       {_running(1)}, example_track FROM top"""


def _hierarchy_sql(profile):
    return dash_ctes(profile) + """
, fails AS (SELECT * FROM filt WHERE failed AND process IS NOT NULL AND station IS NOT NULL)
, anyc AS (SELECT MAX(failed_testcode <> '') AS any_code FROM fails)
SELECT process, station, leaf, COUNT(*) AS count, CAST(GROUPING(process, station, leaf) AS BIGINT) AS level
FROM (SELECT f.*, CASE WHEN COALESCE((SELECT any_code FROM anyc), false) THEN failed_testcode
                       ELSE status_display END AS leaf FROM fails f)
GROUP BY ROLLUP (process, station, leaf)"""


def _wide_sql(long_sql, row, col, value, zero, values):
    cells = ", ".join(f"COALESCE(MAX({value}) FILTER (WHERE {col} = '{v}'), {zero}) AS \"{v}\"" for v in values)
    return f"SELECT {row}, {cells} FROM ({long_sql}) GROUP BY {row}"


_ROWS_SQL = ", ".join(_ROW_COLS)


def _rows_sql(profile, where):
    return dash_ctes(profile, where) + f"SELECT {_ROWS_SQL} FROM filt"


_DEF = Q.DEFAULT_FILTER_SQL


def _search_sql(cols, term):
    return " OR ".join(f"COALESCE(regexp_matches(lower({c}), '{term}'), false)" for c in cols)


ORACLES = {
    "counts_by_process": _status_counts_sql("process"),
    "counts_by_model": _status_counts_sql("model"),
    "counts_by_line": _status_counts_sql("line"),
    "test_kpis": dash_ctes("tests") + f"""
, k AS (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'P') AS passed,
          COUNT(*) FILTER (WHERE status = 'F') AS failed,
          COUNT(DISTINCT track_id) AS unique_tracks, COUNT(DISTINCT station) AS unique_stations,
          COUNT(DISTINCT line) AS unique_lines,
          COUNT(DISTINCT CASE WHEN status = 'F' AND failed_testcode <> '' THEN track_id END) AS failed_tracks_with_code,
          COUNT(DISTINCT CASE WHEN status = 'F' AND failed_testcode = '' THEN track_id END) AS failed_tracks_without_code
        FROM filt)
SELECT k.*, {_pct('passed', 'total', 2)} AS pass_pct, {_pct('failed', 'total', 2)} AS fail_pct,
       (SELECT COUNT(*) FROM prep) AS total_all, total - (SELECT COUNT(*) FROM prep) AS delta FROM k""",
    "failrate_model_line": _matrix_sql("tests", "model", "line"),
    "failrate_model_process": _matrix_sql("tests", "model", "process"),
    "model_process_league": dash_ctes("tests") + f"""
SELECT model, process, total, total - fails AS passed, fails, {_pct('fails', 'total', 1)} AS fail_rate FROM (
  SELECT model, process, COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'F') AS fails
  FROM filt WHERE model IS NOT NULL AND process IS NOT NULL GROUP BY 1, 2)
ORDER BY fail_rate DESC, model, process LIMIT 15""",
    "failed_tracks_model_process": dash_ctes("tests") + """
SELECT model, process, COUNT(DISTINCT track_id) AS failed_tracks FROM filt
WHERE failed AND model IS NOT NULL AND process IS NOT NULL GROUP BY 1, 2""",
    "pareto_codes": _pareto_sql("tests", 20, False, 1),
    "pareto_codes_missing": _pareto_sql("span", 15, True, None),
    "code_detail": _detail_sql("tests", 20, "failed AND failed_testcode <> ''"),
    "failures_by_process": dash_ctes("tests") + """
SELECT process, COUNT(*) AS count FROM filt WHERE failed AND process IS NOT NULL GROUP BY 1""",
    "failure_hierarchy": _hierarchy_sql("tests"),
    "hourly_volume": _grid_sql("span", ["Passed", "Failed"]),
    "daily_trend": dash_ctes("tests") + """
SELECT date, status_display AS status, COUNT(*) AS count FROM filt GROUP BY 1, 2""",
    "minute_trend": dash_ctes("tests", _DEF + " AND date = DATE '2024-01-15'") + """
SELECT date_trunc('minute', event_ts) AS minute, status_display AS status, COUNT(*) AS count
FROM filt GROUP BY 1, 2""",
    "failrate_by_hour": dash_ctes("tests") + f"""
SELECT hour, total, fails, {_pct('fails', 'total', 2)} AS fail_rate FROM (
  SELECT hour, COUNT(*) AS total, COUNT(*) FILTER (WHERE failed) AS fails FROM filt GROUP BY 1)""",
    "station_stats": dash_ctes("tests") + f"""
SELECT station, total, passed, total - passed AS failed, {_pct('total - passed', 'total', 1)} AS fail_rate
FROM (SELECT station, COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'P') AS passed
      FROM filt WHERE station IS NOT NULL GROUP BY 1)""",
    "station_stats_pattern": dash_ctes("pattern") + f"""
SELECT *, {_pct('real_fails', 'total', 1)} AS real_fail_rate, {_pct('ntf', 'total', 1)} AS ntf_rate
FROM (SELECT station, COUNT(*) AS total, COUNT(*) FILTER (WHERE status_display = 'Real Fail') AS real_fails,
             COUNT(*) FILTER (WHERE status_display = 'NTF') AS ntf,
             COUNT(*) FILTER (WHERE status_display = 'Passed') AS passed
      FROM filt WHERE station IS NOT NULL GROUP BY 1)""",
    "station_top15_long": _station_top_sql(
        "tests", ["Passed", "Failed"], "CASE WHEN status = 'P' THEN 'Passed' ELSE 'Failed' END"),
    "station_top15_pattern": _station_top_sql("pattern", ["Passed", "NTF", "Real Fail"], "status_display"),
    "realfail_model_line_tests": _matrix_sql("pattern", "model", "line", "status_display = 'Real Fail'", 1),
    "failure_type_split": dash_ctes("pattern") + """
SELECT status_display AS status, COUNT(*) AS count FROM filt WHERE failed GROUP BY 1""",
    "top3_codes_per_model": dash_ctes("span") + """
SELECT * FROM (
  SELECT model, failed_testcode, count,
         CAST(ROW_NUMBER() OVER (PARTITION BY model ORDER BY count DESC, failed_testcode) AS BIGINT) AS rank
  FROM (SELECT model, failed_testcode, COUNT(*) AS count FROM filt
        WHERE failed AND model IS NOT NULL AND failed_testcode IS NOT NULL GROUP BY 1, 2))
WHERE rank <= 3""",
    "filter_date_time_dims": _rows_sql("tests", (
        "date >= DATE '2024-01-05' AND date <= DATE '2024-01-20' "
        "AND tod >= 21600000000 AND tod <= 66600000000 AND model IS NOT NULL "
        "AND line IN ('L0','L2','L3') AND process IN ('L2AR','UCT','FOD','MANUAL') AND station IS NOT NULL")),
    "shift_presets": dash_ctes("tests") + """
SELECT COUNT(*) FILTER (WHERE tod >= 0 AND tod <= 86340000000) AS day,
       COUNT(*) FILTER (WHERE tod >= 21600000000 AND tod <= 50400000000) AS am,
       COUNT(*) FILTER (WHERE tod >= 50400000000 AND tod <= 79200000000) AS pm FROM filt""",
    "search_rows": _rows_sql("tests", _DEF + " AND (" + _search_sql(
        ["track_id", "station", "model", "line", "process", "failed_testcode"], "wifi") + ")"),
    "search_rows_all_columns": _rows_sql("span", _DEF + " AND (" + _search_sql(
        ["track_id", "model", "line", "process", "station", "status", "failed_testcode",
         "status_display", "strftime(date, '%Y-%m-%d')", "strftime(event_ts, '%H:%M:%S')"],
        "l4_st1|2024-01-07") + ")"),
    "status_filter": _rows_sql("pattern", _DEF + " AND status_display = 'NTF'"),
    "status_filter_failed": _rows_sql("tests", _DEF + " AND status = 'F'"),
    "filter_domains": dash_ctes("tests") + """
SELECT DISTINCT * FROM (
  SELECT 'model' AS dimension, model AS value FROM filt UNION ALL SELECT 'line', line FROM filt
  UNION ALL SELECT 'process', process FROM filt UNION ALL SELECT 'station', station FROM filt)
WHERE value IS NOT NULL""",
    "filter_summary": dash_ctes("tests") + """
SELECT MIN(date) AS min_date, MAX(date) AS max_date, strftime(MIN(event_ts), '%H:%M:%S') AS first_time,
       strftime(MAX(event_ts), '%H:%M:%S') AS last_time, COUNT(*) AS total_rows,
       COUNT(DISTINCT track_id) AS total_tracks FROM prep""",
    "export_rows": dash_ctes("tests") + """
SELECT strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS timestamp, track_id, model, line, station, process,
       status_display, failed_testcode FROM filt""",
    "station_stats_span": dash_ctes("span") + f"""
SELECT station, total, passed, total - passed AS failed, {_pct('total - passed', 'total', 1)} AS fail_rate
FROM (SELECT station, COUNT(*) AS total, COUNT(*) FILTER (WHERE status_display = 'Passed') AS passed
      FROM filt WHERE station IS NOT NULL GROUP BY 1)""",
    "hourly_volume_classes": _grid_sql("pattern", ["Passed", "NTF", "Real Fail"]),
    "pareto_codes_pattern": _pareto_sql("pattern", 15, True, None),
    "code_detail_pattern": _detail_sql("pattern", 10, "failed"),
    "failure_hierarchy_pattern": _hierarchy_sql("pattern"),
    "failrate_model_line_wide": _wide_sql(_matrix_sql("tests", "model", "line"), "model", "line", "fail_pct", "0.0",
                                          _LINES),
    "failed_tracks_model_process_wide": _wide_sql(dash_ctes("tests") + """
SELECT model, process, COUNT(DISTINCT track_id) AS failed_tracks FROM filt
WHERE failed AND model IS NOT NULL AND process IS NOT NULL GROUP BY 1, 2""", "model", "process", "failed_tracks", "0",
                                                  _PROCESSES),
    "mapped_columns": dash_ctes("tests") + """
SELECT process, status_display AS status, COUNT(*) AS count FROM prep WHERE process IS NOT NULL GROUP BY 1, 2""",
}
ORACLES["filter_stored_facts"] = ORACLES["filter_date_time_dims"]
