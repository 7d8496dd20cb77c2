"""Registered queries of the track-classification dashboards."""

from __future__ import annotations

from .. import schemas as K
from ..operators import filters as FL
from ..operators import tracks as TR
from ..operators.prepare import prepare
from . import common as Q
from .common import dash_ctes
from .dashboards import view


def _span_view(s, d):
    return view(s, d, "span", FL.FilterSpec(profile="span"))


def _span_classes(s, d):
    return TR.classify_by_span(_span_view(s, d), K.SPAN_LIMIT_TRACKS)


def _pattern_view(s, d):
    return TR.span_filter(view(s, d, "pattern", FL.FilterSpec(profile="pattern")), K.SPAN_LIMIT_PATTERN)


def _pattern_classes(s, d):
    return TR.classify_by_pattern_within(view(s, d, "pattern", FL.FilterSpec(profile="pattern")), K.SPAN_LIMIT_PATTERN)


def _kpis(s, d):
    # one pass: classes of the filtered rows and the unfiltered track count
    return TR.kpis_one_pass(prepare(Q.facts(s, d), "span"), FL.FilterSpec(profile="span").predicate(),
                            K.SPAN_LIMIT_TRACKS)


def _matrix(status):
    def run(s, d):
        return TR.class_rate_matrix(TR.classify_by_span(_span_view(s, d), attributes=True), status)
    return run


def _by(fn):
    def run(s, d):
        return fn(TR.classify_by_span(_span_view(s, d), attributes=True))
    return run


def _track_status_filter(s, d):
    rows = _span_view(s, d)
    kept = TR.status_filter(rows, TR.classify_by_span(rows), K.NTF)
    return kept.select("id", "track_id", "model", "line", "station", "process", "status", "event_ts")


QUERIES = {
    "track_classes_span": _span_classes,
    "track_classes_pattern": lambda s, d: _pattern_classes(s, d),
    "track_kpis": _kpis,
    "track_kpis_pattern": lambda s, d: TR.kpis(_pattern_classes(s, d)),
    "realfail_model_line_tracks": _matrix(K.REAL_FAIL),
    "ntf_model_line_tracks": _matrix(K.NTF),
    "ntf_daily": _by(TR.classes_by_day),
    "ntf_by_station": _by(TR.classes_by_station),
    "span_histogram": lambda s, d: TR.span_histogram(_span_classes(s, d), 30, K.SPAN_LIMIT_TRACKS),
    "track_status_filter": _track_status_filter,
    "span_filter": lambda s, d: _pattern_view(s, d).select(
        "id", "track_id", "model", "line", "station", "process", "status", "event_ts"),
}

# ---------------------------------------------------------------------------
_SPAN = "CAST(date_diff('second', {a}, {b}) AS DOUBLE) / 60"
_CLASSES = ("classes", f"""
  SELECT track_id, failure_count, failure_span_min,
         CASE WHEN failure_count = 0 THEN 'Passed' WHEN failure_count = 1 THEN 'Failed'
              WHEN failure_span_min <= {float(K.SPAN_LIMIT_TRACKS)} THEN 'NTF' ELSE 'Real Fail' END AS overall_status
  FROM (SELECT track_id, COUNT(*) FILTER (WHERE failed) AS failure_count,
               {_SPAN.format(a='MIN(event_ts) FILTER (WHERE failed)', b='MAX(event_ts) FILTER (WHERE failed)')}
               AS failure_span_min
        FROM filt WHERE track_id IS NOT NULL GROUP BY track_id)""")
_ATTRS = ("attrs", """
  SELECT track_id, arg_min(model, id) AS model, arg_min(line, id) AS line, arg_min(station, id) AS station,
         MIN(event_ts) AS first_test FROM filt WHERE track_id IS NOT NULL GROUP BY track_id""")


def _span_sql(body: str) -> str:
    return dash_ctes("span", extra=[_CLASSES, _ATTRS]) + body


_SPAN_FILTER_CTES = [
    ("stats", f"""SELECT track_id, COUNT(*) FILTER (WHERE failed) AS n,
       COALESCE({_SPAN.format(a='MIN(event_ts) FILTER (WHERE failed)', b='MAX(event_ts) FILTER (WHERE failed)')},
                0.0) AS span FROM filt WHERE track_id IS NOT NULL GROUP BY track_id"""),
    ("kept", f"""SELECT * FROM filt WHERE track_id IN (
       SELECT track_id FROM stats WHERE n <= 1 OR span <= {float(K.SPAN_LIMIT_PATTERN)})"""),
]


_PATTERN_CLASSES = """
SELECT track_id, has_real_fail, has_ntf,
       CASE WHEN has_real_fail THEN 'Real Fail' WHEN has_ntf THEN 'NTF' ELSE 'Passed' END AS overall_status
FROM (SELECT track_id, bool_or(status_display = 'Real Fail') AS has_real_fail,
             bool_or(status_display = 'NTF') AS has_ntf FROM kept WHERE track_id IS NOT NULL GROUP BY 1)"""


def _matrix_sql(status):
    return _span_sql(f"""
SELECT model, line, total_tracks, class_tracks,
       round_even(CAST(class_tracks AS DOUBLE) / total_tracks * 100, 1) AS class_rate FROM (
  SELECT a.model, a.line, COUNT(*) AS total_tracks, COUNT(*) FILTER (WHERE c.overall_status = '{status}')
         AS class_tracks
  FROM classes c JOIN attrs a USING (track_id) WHERE a.model IS NOT NULL AND a.line IS NOT NULL GROUP BY 1, 2)""")


_ROWS = "id, track_id, model, line, station, process, status, event_ts"

ORACLES = {
    "track_classes_span": _span_sql("SELECT * FROM classes"),
    "track_classes_pattern": dash_ctes("pattern", extra=_SPAN_FILTER_CTES) + _PATTERN_CLASSES,
    "track_kpis_pattern": dash_ctes("pattern", extra=[*_SPAN_FILTER_CTES, ("classes", _PATTERN_CLASSES)]) + """
SELECT overall_status, tracks, total_tracks,
       round_even(COALESCE(CAST(tracks AS DOUBLE) / NULLIF(total_tracks, 0) * 100, 0.0), 2) AS pct FROM (
  SELECT overall_status, COUNT(*) AS tracks, (SELECT COUNT(*) FROM classes) AS total_tracks
  FROM classes GROUP BY 1)""",
    "track_kpis": _span_sql("""
SELECT overall_status, tracks, total_tracks, all_tracks,
       round_even(COALESCE(CAST(tracks AS DOUBLE) / NULLIF(total_tracks, 0) * 100, 0.0), 2) AS pct FROM (
  SELECT overall_status, COUNT(*) AS tracks, (SELECT COUNT(*) FROM classes) AS total_tracks,
         (SELECT COUNT(DISTINCT track_id) FROM prep) AS all_tracks
  FROM classes GROUP BY 1)"""),
    "realfail_model_line_tracks": _matrix_sql("Real Fail"),
    "ntf_model_line_tracks": _matrix_sql("NTF"),
    "ntf_daily": _span_sql("""
SELECT CAST(a.first_test AS DATE) AS date, c.overall_status, COUNT(*) AS tracks
FROM classes c JOIN attrs a USING (track_id) WHERE c.overall_status IN ('NTF', 'Real Fail') GROUP BY 1, 2"""),
    "ntf_by_station": _span_sql("""
SELECT a.station, c.overall_status, COUNT(*) AS tracks
FROM classes c JOIN attrs a USING (track_id)
WHERE c.overall_status IN ('NTF', 'Real Fail') AND a.station IS NOT NULL GROUP BY 1, 2"""),
    "span_histogram": _span_sql(f"""
, multi AS (SELECT * FROM classes WHERE failure_count >= 2)
, b AS (SELECT MIN(failure_span_min) AS mn, MAX(failure_span_min) AS mx FROM multi)
, bk AS (SELECT CAST(CASE WHEN mx = mn THEN 1 ELSE LEAST(FLOOR((failure_span_min - mn) * 30 / (mx - mn)) + 1, 30) END
                     AS BIGINT) AS bucket, mn, mx FROM multi, b)
SELECT bucket, mn + (bucket - 1) * ((mx - mn) / 30) AS bin_start, mn + bucket * ((mx - mn) / 30) AS bin_end,
       COUNT(*) AS tracks, CAST({float(K.SPAN_LIMIT_TRACKS)} AS DOUBLE) AS ntf_threshold
FROM bk GROUP BY bucket, mn, mx"""),
    "track_status_filter": _span_sql(f"""
SELECT {_ROWS} FROM filt WHERE track_id IN (SELECT track_id FROM classes WHERE overall_status = 'NTF')"""),
    "span_filter": dash_ctes("pattern", extra=_SPAN_FILTER_CTES) + f"SELECT {_ROWS} FROM kept",
}
