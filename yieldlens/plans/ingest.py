"""Registered queries of the ingest path (E1, E4): parsing, routing,
envelope, gap accounting, reconciliation, processed-file register."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import columns as C
from ..operators import gaps as G
from ..operators import ingest as I
from ..session import scratch, tune_for_parsing
from ..sources import fixtures as fx
from ..sources.files import read_facts, write_facts
from . import common as Q
from .common import with_ctes

REGISTER_CUTOFF = "2024-01-16 00:00:00"
_REC = ["track_id", "process", "model", "line", "station", "status", "failed_tests", "date", "time", "timestamp"]


def _raw(s, d):
    tune_for_parsing(s)
    return fx.raw_files(s, d)


def _routed(s, d):
    return I.route(_raw(s, d))


def _parse_th4(s, d):
    return (I.parse_records(_raw(s, d)).where("has_th4")
            .select("file_id", "filename", *_REC))


def _envelope_decoded(env):
    return I.from_envelope(env).drop("raw")


def _hourly_gap(s, d):
    return G.hourly_gap_routed(I.first_outcomes(_raw(s, d)))


def _hourly_gap_tables(s, d):
    # The fact and skip rows apart, joined by hour
    first = I.first_outcomes(_raw(s, d))
    skips = first.where(F.col("outcome").isin(K.R_PROCESS, K.R_PARSE_ERR)).withColumnRenamed("outcome", "reason")
    return G.hourly_gap(first.where(F.col("outcome") == K.INSERT), skips)


def _reconcile(s, d):
    facts = Q.facts(s, d)
    return G.reconcile(fx.reconciliation_rows(facts), facts)


def _reconcile_csv(s, d):
    """S7 + J1: the external rows from a CSV file, few against the facts."""
    facts = Q.facts(s, d)
    path = f"{scratch(s)}/external"
    fx.reconciliation_rows(facts).write.option("header", True).option("escape", '"').csv(path)
    return G.reconcile(G.read_reconciliation_csv(s, path, line_ends=False), facts, few=True)


def _reconcile_stored(s, d):
    """J1 on the stored fact table, pruned to the external rows' dates."""
    facts = Q.facts(s, d)
    path = f"{scratch(s)}/facts"
    write_facts(facts, path)
    return G.reconcile(fx.reconciliation_rows(facts), read_facts(s, path), by_date=True)


def _unprocessed(s, d):
    raw = _raw(s, d)
    # the register holds every file collected before the cut-off
    register = raw.where(F.col("file_mtime") < F.lit(REGISTER_CUTOFF).cast("timestamp_ntz")).select("filename")
    return I.unprocessed(raw, register).select("file_id", "filename", "source")


QUERIES = {
    "parse_th4": _parse_th4,
    "parse_filename": lambda s, d: _raw(s, d).select(
        "file_id", "filename", C.track_from_filename(F.col("filename")).alias("name_track")),
    "route_outcomes": lambda s, d: _routed(s, d).select("file_id", "filename", "source", "outcome", "track_id"),
    "envelope_roundtrip": lambda s, d: _envelope_decoded(I.to_envelope(
        I.records(_routed(s, d)).withColumnRenamed("failed_testcode", "failed_tests"))),
    "skip_totals": lambda s, d: G.skip_totals(I.skip_log(_routed(s, d))),
    "gap_report": lambda s, d: G.gap_report(I.first_outcomes(_raw(s, d)), count_no_th4=True),
    "gap_report_original": lambda s, d: G.gap_report(I.first_outcomes(_raw(s, d)), count_no_th4=False),
    "gap_report_duplicates": lambda s, d: G.gap_report(I.first_outcomes(_raw(s, d)), count_duplicate=True),
    "hourly_gap": _hourly_gap,
    "hourly_gap_tables": _hourly_gap_tables,
    "register_latest": lambda s, d: I.register_latest(_raw(s, d).select(
        "filename", F.col("file_mtime").alias("processed_time"))),
    "reconcile": _reconcile,
    "reconcile_csv": _reconcile_csv,
    "reconcile_stored": _reconcile_stored,
    "reconcile_totals": lambda s, d: G.reconcile_totals(_reconcile(s, d)),
    "unprocessed_files": _unprocessed,
    "late_caught": lambda s, d: I.late_caught(_routed(s, d)),
}

# ---------------------------------------------------------------------------
# DuckDB twins
# ---------------------------------------------------------------------------
_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_TIME = r"(1[0-2]|0[1-9]|[1-9])/(3[01]|[12]\d|0[1-9]|[1-9])/"
_CLOCK = r" (2[0-3]|[01]\d|\d):([0-5]\d|\d):([0-5]\d|\d)"


def _strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def testcode_sql(x: str) -> str:
    v = _strip(x)
    segs = f"string_split({_strip(f'split_part({v}, chr(59), 1)')}, '_')"
    skip = ", ".join(f"'{t}'" for t in K.TESTCODE_SKIP_VALUES)
    geo = ", ".join(f"'{t}'" for t in K.GEO_SUFFIXES)
    return (f"(len({v}) > 0 AND upper({v}) NOT IN ({skip}) AND NOT starts_with({v}, 'REL.') "
            f"AND contains({v}, '_') AND NOT regexp_matches({v}, '\\p{{Ll}}') "
            f"AND NOT regexp_matches({v}, '^[A-Z]+-[A-Z]') AND list_last({segs}) NOT IN ({geo}) "
            f"AND len({segs}) >= 3 AND (regexp_matches({v}, '\\d{{2,}}') "
            f"OR regexp_matches({v}, '{K.TESTCODE_KEYWORDS}')))")


def name_track_sql(fn: str) -> str:
    base = f"regexp_replace({fn}, '^(\\.*[^.].*)\\.[^.]*$', '\\1')"
    base = f"regexp_replace({base}, '^(ic_|IC_)', '')"
    base = f"replace(replace({base}, '.rslt', ''), '_rslt', '')"
    return _strip(f"string_split_regex({base}, '[_.]')[1]")


def _ts_sql(t):
    return (f"(CASE WHEN regexp_full_match({t}, '{_TIME}\\d{{2}}{_CLOCK}') "
            f"THEN try_strptime({t}, '%m/%d/%y %H:%M:%S') "
            f"WHEN regexp_full_match({t}, '{_TIME}\\d{{4}}{_CLOCK}') "
            f"THEN try_strptime({t}, '%m/%d/%Y %H:%M:%S') END)")


_PARSED = f"""
SELECT *, {_strip('p[2]')} AS track_id, {_strip('p[5]')} AS process, {_strip('p[18]')} AS model,
       CASE WHEN {_strip('p[6]')} = '' OR p[6] IS NULL THEN '' ELSE string_split_regex({_strip('p[6]')}, '[-_]')[1] END AS line,
       {_strip('p[6]')} AS station, {_strip('p[10]')} AS status,
       CASE WHEN {_strip('p[10]')} = 'F' THEN COALESCE(NULLIF({_strip('p[15]')}, ''),
            {_strip(f"list_filter(p[11:16], lambda x: {testcode_sql('x')})[1]")}, '') ELSE '' END AS failed_tests,
       strftime(pts, '%Y-%m-%d') AS date, strftime(pts, '%H:%M:%S') AS time,
       strftime(pts, '%Y-%m-%d %H:%M:%S') AS timestamp, p IS NOT NULL AS has_th4
FROM (SELECT *, {_ts_sql(_strip('p[4]'))} AS pts FROM (
  SELECT *, string_split(list_filter(regexp_split_to_array(content, '{_BREAK}'),
         lambda l: starts_with(l, 'TH4,') AND len(string_split(l, ',')) >= 18)[1], ',') AS p FROM raw))"""

_ALLOWED = ", ".join(f"'{p}'" for p in K.ALLOWED_PROCESSES)
_ROUTED = f"""
SELECT file_id, filename, source, file_mtime, outcome,
       CASE WHEN outcome IN ('NO_TH4', 'FILE_GONE') THEN {name_track_sql('filename')} ELSE track_id END AS track_id,
       process, model, line, station, status, failed_tests, date, time, timestamp
FROM (SELECT *, CASE WHEN rn > 1 THEN 'DUPLICATE' WHEN content IS NULL THEN 'FILE_GONE'
                     WHEN NOT has_th4 OR has_th4 IS NULL THEN 'NO_TH4'
                     WHEN NOT COALESCE(process IN ({_ALLOWED}), false) THEN 'PROCESS_SKIP' ELSE 'INSERT' END AS outcome
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY filename ORDER BY file_mtime, file_id) AS rn FROM parsed))"""

_RECORDS = ("records", """SELECT filename, source, process, model, line, station, status,
       failed_tests AS failed_testcode, track_id, date, time, timestamp FROM routed WHERE outcome = 'INSERT'""")
_SKIPS = ("skips", """SELECT filename, outcome AS reason, COALESCE(process, '') AS process,
       COALESCE(track_id, '') AS track_id, NULLIF(timestamp, '') AS timestamp FROM routed
       WHERE outcome IN ('PROCESS_SKIP', 'PARSE_ERROR')""")


def ingest_ctes(*extra) -> str:
    return with_ctes(Q.log_cte(), ("raw", fx.RAW_FILES_SQL), ("parsed", _PARSED), ("routed", _ROUTED),
                     _RECORDS, _SKIPS, *extra)


def _gap_sql(count_no_th4: bool, count_duplicate: bool = False) -> str:
    counted = ["PROCESS_SKIP", "FILE_GONE", "PARSE_ERROR"] + (["NO_TH4"] if count_no_th4 else [])
    counted += ["DUPLICATE"] if count_duplicate else []
    lst = ", ".join(f"'{r}'" for r in counted)
    reasons = " UNION ALL ".join(f"SELECT '{r}' AS reason" for r in K.SKIP_REASONS)
    return ingest_ctes() + f"""
, t AS (SELECT COUNT(*) FILTER (WHERE outcome = 'INSERT') AS inserted,
               COUNT(*) FILTER (WHERE outcome IN ({lst})) AS skipped,
               COUNT(*) FILTER (WHERE outcome = 'INSERT' AND source IN ('rescan', 'poll')) AS rescan_rows
        FROM routed)
, per AS (SELECT outcome AS reason, COUNT(*) AS n FROM routed WHERE outcome IN ({lst}) GROUP BY 1)
SELECT r.reason, CAST(COALESCE(per.n, 0) AS BIGINT) AS count, t.inserted, t.skipped, t.rescan_rows,
       t.inserted + t.skipped AS seen,
       round_even(COALESCE(CAST(t.skipped AS DOUBLE) / NULLIF(t.inserted + t.skipped, 0) * 100, 0.0), 2) AS gap_pct,
       round_even(COALESCE(CAST(COALESCE(per.n, 0) AS DOUBLE) / NULLIF(t.inserted + t.skipped, 0) * 100, 0.0), 2) AS pct
FROM ({reasons}) r LEFT JOIN per USING (reason), t"""


def _hour(ts):
    t = f"replace(TRIM({ts}), 'T', ' ')"
    return (f"strftime(CASE WHEN regexp_full_match({t}, '{Q.ISO_RE}') THEN TRY_CAST({t} AS TIMESTAMP) END, "
            f"'%Y-%m-%d %H:00')")


_HOURLY = ingest_ctes() + f"""
, ins AS (SELECT {_hour('timestamp')} AS hour, COUNT(*) AS inserted FROM records
          WHERE {_hour('timestamp')} IS NOT NULL GROUP BY 1)
, sk AS (SELECT {_hour('timestamp')} AS hour,
                COUNT(*) FILTER (WHERE reason = 'NO_TH4') AS NO_TH4,
                COUNT(*) FILTER (WHERE reason = 'PROCESS_SKIP') AS PROCESS_SKIP,
                COUNT(*) FILTER (WHERE reason = 'FILE_GONE') AS FILE_GONE,
                COUNT(*) FILTER (WHERE reason = 'PARSE_ERROR') AS PARSE_ERROR
         FROM skips WHERE {_hour('timestamp')} IS NOT NULL GROUP BY 1)
, j AS (SELECT COALESCE(ins.hour, sk.hour) AS hour, CAST(COALESCE(inserted, 0) AS BIGINT) AS inserted,
               CAST(COALESCE(NO_TH4, 0) AS BIGINT) AS NO_TH4, CAST(COALESCE(PROCESS_SKIP, 0) AS BIGINT) AS PROCESS_SKIP,
               CAST(COALESCE(FILE_GONE, 0) AS BIGINT) AS FILE_GONE, CAST(COALESCE(PARSE_ERROR, 0) AS BIGINT) AS PARSE_ERROR
        FROM ins FULL OUTER JOIN sk ON ins.hour = sk.hour)
SELECT *, inserted + NO_TH4 + PROCESS_SKIP + FILE_GONE + PARSE_ERROR AS total,
       round_even(COALESCE(CAST(NO_TH4 + PROCESS_SKIP + FILE_GONE + PARSE_ERROR AS DOUBLE)
                  / NULLIF(inserted + NO_TH4 + PROCESS_SKIP + FILE_GONE + PARSE_ERROR, 0) * 100, 0.0), 2) AS gap_pct
FROM j"""


_RECONCILE = with_ctes(Q.log_cte(), ("csv", fx.RECONCILIATION_SQL), ("ext", f"""
    SELECT {', '.join(f"COALESCE({_strip(c)}, '') AS {c}" for c in ['Track_ID', 'Process', 'Station', 'Date', 'Time', 'Reason'])}
    FROM csv"""), ("hits", """
    SELECT track_id, process, date, arg_min_null(timestamp, id) AS db_timestamp FROM log_data
    WHERE (track_id, process, date) IN (SELECT (Track_ID, Process, Date) FROM ext)
    GROUP BY 1, 2, 3"""), ("rec", """
    SELECT e.Track_ID AS track_id, e.Process AS process, e.Station AS station,
           CASE WHEN e.Date <> '' AND e.Time <> '' THEN e.Date || ' ' || e.Time END AS mqs_timestamp,
           e.Reason AS mqs_status, CAST(CASE WHEN h.track_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS found_in_db,
           h.db_timestamp, 'auto-reconciled' AS note
    FROM ext e LEFT JOIN hits h ON e.Track_ID = h.track_id AND e.Process = h.process AND e.Date = h.date"""))

_ENV = ", ".join(f"{f}" for f in K.RECORD_FIELDS)

ORACLES = {
    "parse_th4": ingest_ctes() + f"SELECT file_id, filename, {', '.join(_REC)} FROM parsed WHERE has_th4",
    "parse_filename": ingest_ctes() + f"SELECT file_id, filename, {name_track_sql('filename')} AS name_track FROM raw",
    "route_outcomes": ingest_ctes() + "SELECT file_id, filename, source, outcome, track_id FROM routed",
    "envelope_roundtrip": ingest_ctes() + f"""
SELECT track_id AS key, {', '.join(('failed_testcode AS failed_tests' if f == 'failed_tests' else f) for f in K.RECORD_FIELDS)},
       filename, source, false AS bad_json FROM records""",
    "skip_totals": ingest_ctes() + "SELECT reason, COUNT(*) AS count FROM skips GROUP BY 1",
    "gap_report": _gap_sql(True),
    "gap_report_original": _gap_sql(False),
    "gap_report_duplicates": _gap_sql(True, True),
    "hourly_gap": _HOURLY,
    "hourly_gap_tables": _HOURLY,
    "register_latest": ingest_ctes() + "SELECT filename, MAX(file_mtime) AS processed_time FROM raw GROUP BY 1",
    "reconcile": _RECONCILE + "SELECT * FROM rec",
    "reconcile_csv": _RECONCILE + "SELECT * FROM rec",
    "reconcile_stored": _RECONCILE + "SELECT * FROM rec",
    "reconcile_totals": _RECONCILE + """
SELECT COUNT(*) AS inserted, COUNT(*) FILTER (WHERE found_in_db = 1) AS matched,
       COUNT(*) - COUNT(*) FILTER (WHERE found_in_db = 1) AS missing FROM rec""",
    "unprocessed_files": ingest_ctes() + f"""
SELECT file_id, filename, source FROM raw
WHERE filename NOT IN (SELECT filename FROM raw WHERE file_mtime < TIMESTAMP '{REGISTER_CUTOFF}')""",
    "late_caught": ingest_ctes() + """
SELECT filename, track_id, process FROM routed WHERE outcome = 'INSERT' AND source IN ('rescan', 'poll')""",
}
