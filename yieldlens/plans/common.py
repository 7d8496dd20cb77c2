"""Shared pieces of the registered queries: the fixed parameters of the
correctness runs and the DuckDB CTE text mirroring each Spark building block.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..session import tune_for_parsing
from ..sources import fixtures as fx

# Fixed parameters of the registered queries (FIXTURES.md §3, SURVEY §7.2).
ASOF = fx.ASOF
WINDOW = 1440
THRESHOLD = 10.0
MIN_SAMPLES = 5
TOP_LINES = 3
TOP_CODES = 3


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the registered plans carry large expression trees (text parsing,
    # message parsing); constraint inference over them only costs planning time
    tune_for_parsing(spark)
    return fx.log_data(spark, sf_dir)


def cutoff_text(asof: str = ASOF, minutes: int = WINDOW) -> str:
    base = datetime.strptime(asof, "%Y-%m-%d %H:%M:%S")
    return (base - timedelta(minutes=minutes)).strftime("%Y-%m-%d %H:%M:%S")


# ---------------------------------------------------------------------------
# DuckDB CTE text
# ---------------------------------------------------------------------------
ISO_RE = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?"
FAIL_SQL = "(UPPER(TRIM(status)) IN ('F','FAIL','FAILED'))"


def iso_ts_sql(expr: str) -> str:
    t = f"replace(TRIM({expr}), 'T', ' ')"
    return f"(CASE WHEN regexp_full_match({t}, '{ISO_RE}') THEN TRY_CAST({t} AS TIMESTAMP) END)"


NORM_TS_SQL = "replace(COALESCE(NULLIF(TRIM(timestamp), ''), date || ' ' || time), 'T', ' ')"


def with_ctes(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n"


def log_cte() -> tuple[str, str]:
    return ("log_data", fx.LOG_DATA_SQL)


def alert_facts_cte() -> tuple[str, str]:
    return ("facts", f"SELECT *, {iso_ts_sql(NORM_TS_SQL)} AS event_ts FROM log_data")


def latest_cte(asof: str = ASOF, minutes: int = WINDOW) -> list[tuple[str, str]]:
    cut = cutoff_text(asof, minutes)
    cols = "id, track_id, line, station, status, failed_testcode, process, event_ts"
    tracked = "track_id IS NOT NULL AND TRIM(track_id) <> ''"
    return [
        ("win", f"SELECT * FROM facts WHERE event_ts >= TIMESTAMP '{cut}'"),
        ("latest", f"""
            SELECT {cols} FROM (
              SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY event_ts DESC, id DESC) AS rn
              FROM win WHERE {tracked}) WHERE rn = 1
            UNION ALL
            SELECT {cols} FROM win WHERE NOT ({tracked})"""),
    ]


def alert_ctes(asof: str = ASOF, minutes: int = WINDOW) -> str:
    return with_ctes(log_cte(), alert_facts_cte(), *latest_cte(asof, minutes))


# --- dashboard profiles (twin of operators.prepare / filters) ---------------
def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _tok(c: str, tokens: list[str]) -> str:
    lst = ", ".join(f"'{t}'" for t in tokens)
    return f"(CASE WHEN {c} IN ({lst}) THEN NULL ELSE {c} END)"


def ntf_match_sql(code: str) -> str:
    from .. import schemas as K
    return f"(regexp_matches({code}, '(?i)({'|'.join(K.NTF_PATTERNS)})') OR {code} = 'MISSING_CODE')"


def prep_sql(profile: str) -> str:
    from .. import schemas as K
    if profile == "tests":
        t = lambda c: _tok(_strip(c), K.NULL_TOKENS_TESTS)
        dims = (f"COALESCE({t('model')}, 'Unknown') AS model, {t('line')} AS line, "
                f"{t('station')} AS station, {t('process')} AS process, "
                f"COALESCE({t('failed_testcode')}, '') AS failed_testcode")
    else:
        dims = ("CASE WHEN model IS NULL OR model IN ('No Data Found','NULL','') THEN 'Unknown' "
                "ELSE model END AS model, line, station, process, "
                "CASE WHEN COALESCE(failed_testcode, '') IN ('NULL','None','') THEN 'MISSING_CODE' "
                "ELSE failed_testcode END AS failed_testcode")
    status, failed = f"upper({_strip('status')})", "F"
    if profile != "tests":
        status, failed = f"CASE {status} WHEN 'P' THEN 'PASSED' WHEN 'F' THEN 'FAILED' ELSE {status} END", "FAILED"
    base = (f"SELECT id, track_id, {dims}, {status} AS status, "
            f"{iso_ts_sql('timestamp')} AS event_ts FROM log_data")
    if profile == "tests":
        label = "CASE WHEN status = 'P' THEN 'Passed' WHEN status = 'F' THEN 'Failed' ELSE 'Unknown' END"
    elif profile == "span":
        label = "CASE WHEN status = 'FAILED' THEN 'Failed' ELSE 'Passed' END"
    else:
        label = (f"CASE WHEN NOT COALESCE(status = 'FAILED', false) THEN 'Passed' "
                 f"WHEN {ntf_match_sql('failed_testcode')} THEN 'NTF' ELSE 'Real Fail' END")
    return (f"SELECT *, CAST(event_ts AS DATE) AS date, hour(event_ts) AS hour, "
            f"(hour(event_ts) * 3600 + minute(event_ts) * 60) * 1000000 + microsecond(event_ts) AS tod, "
            f"COALESCE(status = '{failed}', false) AS failed, {label} AS status_display "
            f"FROM ({base}) WHERE event_ts IS NOT NULL")


DEFAULT_FILTER_SQL = ("model IS NOT NULL AND line IS NOT NULL AND process IS NOT NULL "
                      "AND station IS NOT NULL")


def dash_ctes(profile: str, where: str = DEFAULT_FILTER_SQL, extra: list | None = None) -> str:
    return with_ctes(log_cte(), ("prep", prep_sql(profile)),
                     ("filt", f"SELECT * FROM prep WHERE {where}"), *(extra or []))
