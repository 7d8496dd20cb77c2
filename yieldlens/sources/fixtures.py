"""Test-input adapter: derive the fact table ``log_data`` from the driver's
``events`` table (one narrow projection, fused into the parquet scan), plus
the other derived fixtures (raw result-file text, reconciliation rows, alert
state, engineer messages).

Every derivation exists twice: as Spark columns and as DuckDB SQL text used
by the correctness oracles. Both follow FIXTURES.md §3/§4 rule by rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASOF = "2024-01-30 23:59:59"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _bad(i: Column, u: Column, et: Column) -> Column:
    return ((et == "error") & ~((u % 5 == 4) & (i % 4 != 0)) & ~((u % 5 == 3) & (i % 2 == 0)))


def _process(i: Column) -> Column:
    names = ["L2AR", "L2VISION", "UCT", "FOD", "DepthVal", "DepthCal", "L2AR", "MANUAL"]
    expr = F.when(i % 8 == 0, names[0])
    for k in range(1, 8):
        expr = expr.when(i % 8 == k, names[k])
    return expr


_CODES = ["TC_WIFI_RSSI_01;TC_GPS_02", "TC_WIFI_RSSI_01", "TC_AUDIO_LEVEL_03",
          "BARCODE_NOT_FOUND_04", "COMMUNICATION_TIMEOUT_05", "", "NULL",
          "TC_CAMERA_BLEMISH_06", "TC_BATTERY_CHARGE_07", None]


_BAD_EXPR = ("(event_type = 'error' AND NOT (user_id % 5 = 4 AND event_id % 4 <> 0) "
             "AND NOT (user_id % 5 = 3 AND event_id % 2 = 0))")


def _code_expr() -> str:
    whens = " ".join(f"WHEN event_id % 10 = {k} THEN " + ("CAST(NULL AS STRING)" if c is None else f"'{c}'")
                     for k, c in enumerate(_CODES))
    return f"CASE {whens} END"


# The adapter as Spark SQL expressions: one ``selectExpr`` call builds the
# whole projection (the Column-API form needs ~150 driver round trips).
LOG_DATA_EXPRS = [
    "event_id + 1 AS id",
    "CASE event_id % 8 WHEN 0 THEN 'L2AR' WHEN 1 THEN 'L2VISION' WHEN 2 THEN 'UCT' WHEN 3 THEN 'FOD' "
    "WHEN 4 THEN 'DepthVal' WHEN 5 THEN 'DepthCal' WHEN 6 THEN 'L2AR' ELSE 'MANUAL' END AS process",
    "CASE WHEN event_id % 53 = 0 THEN 'No Data Found' WHEN event_id % 59 = 0 THEN '' "
    "ELSE concat('M', CAST(user_id % 4 AS STRING)) END AS model",
    "concat('L', CAST(user_id % 5 AS STRING)) AS line",
    "CASE WHEN event_id % 79 = 0 THEN CAST(NULL AS STRING) ELSE concat('L', CAST(user_id % 5 AS STRING), "
    "CASE WHEN event_id % 2 = 0 THEN '-' ELSE '_' END, 'ST', CAST(event_id % 11 AS STRING)) END AS station",
    f"CASE WHEN {_BAD_EXPR} THEN (CASE WHEN event_id % 13 = 0 THEN 'FAIL' WHEN event_id % 17 = 0 THEN ' f ' "
    "ELSE 'F' END) ELSE (CASE WHEN event_id % 89 = 0 THEN 'X' ELSE 'P' END) END AS status",
    f"CASE WHEN {_BAD_EXPR} THEN {_code_expr()} ELSE '' END AS failed_testcode",
    "CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 101 = 0 THEN '  ' "
    "ELSE concat('T', CAST(user_id AS STRING), '-', date_format(ts, 'yyyyMMdd')) END AS track_id",
    "date_format(ts, 'yyyy-MM-dd') AS date",
    "date_format(ts, 'HH:mm:ss') AS time",
    "CASE WHEN event_id % 41 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 43 = 0 THEN '' "
    "WHEN event_id % 47 = 0 THEN 'not a time' "
    "WHEN event_id % 3 = 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") "
    "ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS timestamp",
]


def log_data_from_events(ev: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """FIXTURES §3: ``events`` -> ``log_data`` (all text columns, id bigint).
    ``keep`` passes event columns through (for the other derived fixtures)."""
    return ev.selectExpr(*LOG_DATA_EXPRS, *keep)


def log_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_data_from_events(events(spark, sf_dir))


# ---------------------------------------------------------------------------
# DuckDB twin (oracle side). ``LOG_DATA_SQL`` is a SELECT over ``events``.
# ---------------------------------------------------------------------------
_BAD_SQL = ("(event_type = 'error' AND NOT (user_id % 5 = 4 AND event_id % 4 <> 0) "
            "AND NOT (user_id % 5 = 3 AND event_id % 2 = 0))")


def _code_sql() -> str:
    parts = []
    for k, c in enumerate(_CODES):
        parts.append(f"WHEN event_id % 10 = {k} THEN " + ("NULL" if c is None else f"'{c}'"))
    return "CASE " + " ".join(parts) + " END"


LOG_DATA_SQL = f"""
SELECT event_id + 1 AS id,
  CASE event_id % 8 WHEN 0 THEN 'L2AR' WHEN 1 THEN 'L2VISION' WHEN 2 THEN 'UCT' WHEN 3 THEN 'FOD'
       WHEN 4 THEN 'DepthVal' WHEN 5 THEN 'DepthCal' WHEN 6 THEN 'L2AR' ELSE 'MANUAL' END AS process,
  CASE WHEN event_id % 53 = 0 THEN 'No Data Found' WHEN event_id % 59 = 0 THEN ''
       ELSE 'M' || CAST(user_id % 4 AS VARCHAR) END AS model,
  'L' || CAST(user_id % 5 AS VARCHAR) AS line,
  CASE WHEN event_id % 79 = 0 THEN NULL
       ELSE 'L' || CAST(user_id % 5 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '-' ELSE '_' END
            || 'ST' || CAST(event_id % 11 AS VARCHAR) END AS station,
  CASE WHEN {_BAD_SQL} THEN (CASE WHEN event_id % 13 = 0 THEN 'FAIL' WHEN event_id % 17 = 0 THEN ' f ' ELSE 'F' END)
       ELSE (CASE WHEN event_id % 89 = 0 THEN 'X' ELSE 'P' END) END AS status,
  CASE WHEN {_BAD_SQL} THEN {_code_sql()} ELSE '' END AS failed_testcode,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 101 = 0 THEN '  '
       ELSE 'T' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') END AS track_id,
  strftime(ts, '%Y-%m-%d') AS date,
  strftime(ts, '%H:%M:%S') AS time,
  CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN ''
       WHEN event_id % 47 = 0 THEN 'not a time'
       WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS timestamp
FROM events
"""


# ---------------------------------------------------------------------------
# Raw result files (FIXTURES §4): one file per event, plus a second copy of
# the file name for every 50th event. Content: a header row, for every 37th
# event a short (10-field) TH4 row, then the 20-field TH4 row (absent for
# every 31st event). Line ends CRLF for odd ids. Time text MM/dd/yy HH:mm:ss
# for even ids, M/d/yyyy H:mm:ss for odd. The failure code sits in field 14,
# or in field 12 with 14 blank for every 3rd event. Every 211th file is gone
# (null content).
# ---------------------------------------------------------------------------
RAW_SOURCES = ["watchdog", "poll", "rescan", "startup"]


def _raw_exprs() -> tuple[list[str], list[str]]:
    """Spark SQL expressions of the raw-file fixture (one call per step)."""
    code = "coalesce(failed_testcode, '')"
    tm = ("CASE WHEN event_id % 2 = 0 THEN date_format(ts, 'MM/dd/yy HH:mm:ss') "
          "ELSE date_format(ts, 'M/d/yyyy H:mm:ss') END")
    fields = ["'TH4'", "coalesce(track_id, '')", "concat('S', CAST(event_id AS STRING))", tm, "process",
              "coalesce(station, '')", "'X6'", "'X7'", "'X8'", "status", "'N/A'", "''",
              f"CASE WHEN event_id % 3 = 0 THEN {code} ELSE '' END", "''",
              f"CASE WHEN event_id % 3 = 0 THEN '' ELSE {code} END", "'REL.1_2_3'", "'X16'",
              "model", "'X18'", "'X19'"]
    th4 = "concat_ws(',', " + ", ".join(fields) + ")"
    eol = "(CASE WHEN event_id % 2 = 1 THEN '\\r\\n' ELSE '\\n' END)"
    short = "concat('TH4,', coalesce(track_id, ''), ',a,b,c,d,e,f,g,h')"
    content = (f"concat('HDR,', CAST(event_id AS STRING), {eol}, "
               f"CASE WHEN event_id % 37 = 0 THEN concat({short}, {eol}) ELSE '' END, "
               f"CASE WHEN event_id % 31 = 0 THEN '' ELSE concat({th4}, {eol}) END)")
    src = ("CASE event_id % 4 WHEN 0 THEN 'watchdog' WHEN 1 THEN 'poll' WHEN 2 THEN 'rescan' "
           "ELSE 'startup' END")
    first = [
        "event_id",
        "concat('ic_', coalesce(trim(track_id), ''), '_', CAST(event_id AS STRING), '.rslt') AS filename",
        f"CASE WHEN event_id % 211 = 0 THEN CAST(NULL AS STRING) ELSE {content} END AS content",
        f"{src} AS source", "ts AS file_mtime",
        "explode(CASE WHEN event_id % 50 = 0 THEN array(0, 1) ELSE array(0) END) AS copy",
    ]
    second = [
        "event_id * 2 + copy AS file_id", "filename", "content",
        "CASE WHEN copy = 1 THEN 'rescan' ELSE source END AS source",
        "CASE WHEN copy = 1 THEN file_mtime + INTERVAL 1 SECOND ELSE file_mtime END AS file_mtime",
    ]
    return first, second


def raw_files_from_events(ev: DataFrame) -> DataFrame:
    first, second = _raw_exprs()
    return log_data_from_events(ev, keep=("event_id", "ts")).selectExpr(*first).selectExpr(*second)


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_files_from_events(events(spark, sf_dir))


def _raw_sql() -> str:
    code = "COALESCE(failed_testcode, '')"
    tm = ("CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%m/%d/%y %H:%M:%S') "
          "ELSE strftime(ts, '%-m/%-d/%Y %-H:%M:%S') END")
    fields = ["'TH4'", "COALESCE(track_id, '')", "'S' || CAST(event_id AS VARCHAR)", tm, "process",
              "COALESCE(station, '')", "'X6'", "'X7'", "'X8'", "status", "'N/A'", "''",
              f"CASE WHEN event_id % 3 = 0 THEN {code} ELSE '' END", "''",
              f"CASE WHEN event_id % 3 = 0 THEN '' ELSE {code} END", "'REL.1_2_3'", "'X16'",
              "model", "'X18'", "'X19'"]
    th4 = "concat_ws(',', " + ", ".join(fields) + ")"
    eol = "(CASE WHEN event_id % 2 = 1 THEN chr(13) || chr(10) ELSE chr(10) END)"
    short = "'TH4,' || COALESCE(track_id, '') || ',a,b,c,d,e,f,g,h'"
    content = (f"'HDR,' || CAST(event_id AS VARCHAR) || {eol} || "
               f"(CASE WHEN event_id % 37 = 0 THEN {short} || {eol} ELSE '' END) || "
               f"(CASE WHEN event_id % 31 = 0 THEN '' ELSE {th4} || {eol} END)")
    src = "CASE event_id % 4 WHEN 0 THEN 'watchdog' WHEN 1 THEN 'poll' WHEN 2 THEN 'rescan' ELSE 'startup' END"
    log_with = LOG_DATA_SQL.replace("FROM events", ", event_id, ts FROM events")
    return f"""
SELECT event_id * 2 + copy AS file_id,
       'ic_' || COALESCE(trim(track_id), '') || '_' || CAST(event_id AS VARCHAR) || '.rslt' AS filename,
       CASE WHEN event_id % 211 = 0 THEN NULL ELSE {content} END AS content,
       CASE WHEN copy = 1 THEN 'rescan' ELSE {src} END AS source,
       CASE WHEN copy = 1 THEN ts + INTERVAL 1 SECOND ELSE ts END AS file_mtime
FROM ({log_with}) l, (SELECT unnest([0, 1]) AS copy) c
WHERE copy = 0 OR event_id % 50 = 0
"""


RAW_FILES_SQL = _raw_sql()


# ---------------------------------------------------------------------------
# Reconciliation CSV rows: every log_data row is reported by the external
# system (rows with id % 60 = 0 twice), plus an unknown track ZZ<id> for
# id % 200 = 0.
# ---------------------------------------------------------------------------
def reconciliation_rows(facts: DataFrame) -> DataFrame:
    i = F.col("id")
    variants = F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)),
                        lambda v: (v == 0) | ((v == 1) & (i % 60 == 0)) | ((v == 2) & (i % 200 == 0)))
    rows = facts.select("*", F.explode(variants).alias("v"))
    return rows.select(
        F.when(F.col("v") == 2, F.concat(F.lit("ZZ"), i.cast("string")))
         .otherwise(F.coalesce(F.col("track_id"), F.lit(""))).alias("Track_ID"),
        F.col("process").alias("Process"), F.coalesce(F.col("station"), F.lit("")).alias("Station"),
        F.col("date").alias("Date"), F.col("time").alias("Time"),
        F.concat(F.lit("MQS-"), F.upper(F.trim(F.col("status")))).alias("Reason"))


RECONCILIATION_SQL = """
SELECT CASE WHEN v = 2 THEN 'ZZ' || CAST(id AS VARCHAR) ELSE COALESCE(track_id, '') END AS Track_ID,
       process AS Process, COALESCE(station, '') AS Station, date AS Date, time AS Time,
       'MQS-' || upper(trim(status)) AS Reason
FROM log_data, (SELECT unnest([0, 1, 2]) AS v) vs
WHERE v = 0 OR (v = 1 AND id % 60 = 0) OR (v = 2 AND id % 200 = 0)
"""


# ---------------------------------------------------------------------------
# Alert state (FIXTURES §4, refined): one alert per (day, line, run of 1,000 row ids),
# so alerts grow with the facts, with the rate of the deduplicated rows there;
# id = the smallest row id of these rows (unique at any size); sent
# 23:00 (day 13: unparsable sent text); open when day % 3 = 0 and the line
# number is even, else resolved after 20 + 13 * (day % 10) minutes. The
# ranked-code JSON uses the old key names (failed / total) for even ids.
# ---------------------------------------------------------------------------
def alert_state(facts: DataFrame) -> DataFrame:
    from ..functions import columns as C
    from ..operators.dedup import DEDUP_COLS, latest_per_key
    rows = (facts.withColumn("event_ts", C.parse_iso_ts(C.normalized_ts_text()))
            .where(F.col("event_ts").isNotNull())
            .withColumn("_d", F.to_date("event_ts")))
    latest = latest_per_key(rows.select(*DEDUP_COLS, "event_ts", "_d"), ["_d", "track_id"],
                            DEDUP_COLS + ["_d"])
    per = (latest.groupBy("_d", "line", F.floor(F.col("id") / 1000).alias("_run"))
           .agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("total"),
                F.count_if(C.alert_failed()).cast("long").alias("failed")))
    day = F.dayofmonth("_d")
    li = F.substr(F.col("line"), F.lit(2)).cast("int")
    aid = F.col("_first")
    mins = (20 + 13 * (day % 10)).cast("double")
    sent_ts = F.col("_d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(23))
    resolved = ~((day % 3 == 0) & (li % 2 == 0))
    pct_int = F.floor(F.col("failed") * 100 / F.col("total")).cast("long")
    code_new = F.format_string('[{"rank": 1, "testcode": "TC_%s_01", "process": "L2AR", '
                               '"failed_units": %d, "total_line": %d, "rate": %d}]',
                               F.col("line"), F.col("failed"), F.col("total"), pct_int)
    code_old = F.format_string('[{"rank": 1, "testcode": "TC_%s_01", "process": "L2AR", '
                               '"failed": %d, "total": %d, "rate": %d}]',
                               F.col("line"), F.col("failed"), F.col("total"), pct_int)
    return per.select(
        aid.alias("id"), F.lit("log_data").alias("source_table"), "line",
        F.concat(F.col("line"), F.lit("-ST"), (day % 11).cast("string")).alias("station"),
        F.bround(F.col("failed") / F.col("total") * 100, 2).alias("line_failure_rate"),
        F.col("total").cast("long").alias("total_tests"), F.col("failed").alias("failed_tests"),
        F.when(aid % 2 == 0, code_old).otherwise(code_new).alias("top_testcodes"),
        F.when(day == 13, F.lit("bad time")).otherwise(F.date_format(sent_ts, "yyyy-MM-dd HH:mm:ss"))
         .alias("alert_sent_at"),
        resolved.cast("int").alias("resolved"),
        F.when(resolved, F.date_format(sent_ts + F.make_dt_interval(F.lit(0), F.lit(0), mins.cast("int")),
                                       "yyyy-MM-dd HH:mm:ss")).alias("resolved_at"),
        F.when(resolved, mins).alias("resolution_mins"),
        F.when(resolved, (mins <= 60).cast("int")).alias("within_sla"),
        F.lit(None).cast("string").alias("telegram_msg_id"),
        F.col("_d").alias("_day"))


def alerts_table(facts: DataFrame) -> DataFrame:
    return alert_state(facts).drop("_day")


def repair_state(alerts: DataFrame) -> DataFrame:
    """One repair row per alert (id = 2 * alert id), alert id left null when
    alert id % 5 = 0; a second, newer row (id + 1) when alert id % 7 = 0; a
    row with unit ``ALERT-x`` on day 2, line L1."""
    a = alerts
    day = F.dayofmonth("_day") if "_day" in a.columns else F.lit(0)
    li = F.substr(F.col("line"), F.lit(2)).cast("int")
    second = a["id"] % 7 == 0
    oddity = (day == 2) & (li == 1) & ~second
    ks = F.filter(F.array(F.lit(0), F.lit(1)), lambda k: (k == 0) | second | oddity)
    r = a.select("*", F.explode(ks).alias("k"), oddity.alias("_odd"))
    status = F.when(F.col("resolved") == 1, F.lit("Closed")).otherwise(F.lit("Open"))
    unit = F.concat(F.lit("ALERT-"), F.col("id").cast("string"))
    return r.select(
        (F.col("id") * 2 + F.col("k")).cast("long").alias("id"),
        F.when((F.col("k") == 0) & (F.col("id") % 5 == 0), F.lit(None))
         .when((F.col("k") == 1) & F.col("_odd"), F.lit(None))
         .otherwise(F.col("id")).cast("long").alias("alert_id"),
        F.when((F.col("k") == 1) & F.col("_odd"), F.lit("ALERT-x")).otherwise(unit).alias("unit_id"),
        "line", "station", status.alias("status"),
        F.lit(None).cast("string").alias("failure_description"),
        F.when((F.col("k") == 1) & ~F.col("_odd"), F.concat(F.lit("earlier rca "), F.col("id").cast("string")))
         .alias("rca_text"),
        F.lit(None).cast("string").alias("action_taken"), F.lit(None).cast("string").alias("capa_text"),
        F.lit(None).cast("string").alias("engineer_contact"),
        F.col("alert_sent_at").alias("created_at"), F.col("alert_sent_at").alias("updated_at"),
        F.col("resolved_at").alias("closed_at"))


# Engineer messages per alert: (sequence, kind, text rule, condition on id).
MESSAGE_RULES = [
    (0, "text", "RCA:{id}:root cause {id}", "id % 6 = 0"),
    (0, "text", "ACTION:{id}:action {id}", "id % 6 = 1"),
    (0, "text", "CAPA:{id}:capa {id}", "id % 6 = 2"),
    (0, "text", "DESC:{id}:desc {id}", "id % 6 = 3"),
    (0, "text", "RESOLVE:{id}", "id % 6 = 4"),
    (0, "button", "act_{id}_Cleaned components", "id % 6 = 5"),
    (1, "photo", "IMG:{id}:after repair", "id % 4 = 0"),
    (2, "photo", "IMG:{id}", "id % 9 = 0"),
    (3, "text", "rca:{id}: cause: with: colons", "id % 8 = 0"),
    (4, "text", "RESOLVE:{id}", "id % 12 = 4"),
    (5, "text", "RCA::x", "id % 10 = 1"),
    (6, "text", "RCA:abc:x", "id % 10 = 1"),
    (7, "text", "RESOLVE:", "id % 10 = 1"),
    (8, "text", "RCA:999999:unknown alert", "id % 10 = 1"),
    (9, "text", "hello", "id % 10 = 1"),
    (10, "button", "resolve_999999", "id % 10 = 1"),
    (11, "button", "resolve_{id}", "id % 10 = 3"),
    (12, "text", "ACTION:{id}:second action", "id % 10 = 7"),
    (13, "photo", "IMG:abc:x", "id % 10 = 9"),
]


def _rule_cond_spark(cond: str) -> Column:
    # "id % a = b"
    a, b = cond.replace("id %", "").split("=")
    return F.col("id") % int(a) == int(b)


def messages(alerts: DataFrame) -> DataFrame:
    """All message rules in one pass: an array of candidate messages per
    alert, exploded and filtered (one scan, no union of branches)."""
    base = alerts.select("id", F.col("_day").cast("timestamp_ntz").alias("_t0"))
    ident = F.col("id").cast("string")
    rules = []
    for seq, kind, rule, cond in MESSAGE_RULES:
        pieces = rule.split("{id}")
        text = F.concat(*[x for p in pieces for x in (F.lit(p), ident)][:-1])
        rules.append(F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"),
                              _rule_cond_spark(cond).alias("ok")))
    out = base.select("id", "_t0", F.explode(F.array(*rules)).alias("r")).where(F.col("r.ok"))
    return out.select(
        (F.col("id") * 100 + F.col("r.seq")).cast("long").alias("msg_id"),
        (F.col("_t0") + F.make_dt_interval(F.lit(0), F.lit(23), (F.col("r.seq") + 1) * 7)).alias("ts"),
        F.concat(F.lit("eng"), (F.col("id") % 3).cast("string")).alias("user"),
        F.col("r.kind").alias("kind"), F.col("r.text").alias("text"))


def alerts_sql() -> str:
    """DuckDB twin of ``alert_state`` (a SELECT over ``log_data``)."""
    norm = "replace(COALESCE(NULLIF(TRIM(timestamp), ''), date || ' ' || time), 'T', ' ')"
    iso = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
    ts = f"(CASE WHEN regexp_full_match({norm}, '{iso}') THEN TRY_CAST({norm} AS TIMESTAMP) END)"
    tracked = "track_id IS NOT NULL AND TRIM(track_id) <> ''"
    cols = "id, track_id, line, station, status, failed_testcode, process, event_ts, d"
    return f"""
WITH src AS (SELECT *, CAST(event_ts AS DATE) AS d FROM (SELECT *, {ts} AS event_ts FROM log_data)
             WHERE event_ts IS NOT NULL),
lat AS (SELECT {cols} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY d, track_id ORDER BY event_ts DESC, id DESC)
                            AS rn FROM src WHERE {tracked}) WHERE rn = 1
        UNION ALL SELECT {cols} FROM src WHERE NOT ({tracked})),
per AS (SELECT d, line, MIN(id) AS first_id, COUNT(*) AS total,
               CAST(SUM(CASE WHEN UPPER(TRIM(status)) IN ('F','FAIL','FAILED') THEN 1 ELSE 0 END) AS BIGINT) AS failed
        FROM lat GROUP BY d, line, id // 1000),
b AS (SELECT *, day(d) AS dd, CAST(substr(line, 2) AS INTEGER) AS li,
             CAST(20 + 13 * (day(d) % 10) AS DOUBLE) AS mins, CAST(d AS TIMESTAMP) + INTERVAL 23 HOUR AS sent_ts,
             CAST(failed * 100 // total AS BIGINT) AS pct_int FROM per)
SELECT first_id AS id, 'log_data' AS source_table, line,
       line || '-ST' || CAST(dd % 11 AS VARCHAR) AS station,
       round_even(CAST(failed AS DOUBLE) / total * 100, 2) AS line_failure_rate,
       CAST(total AS BIGINT) AS total_tests, failed AS failed_tests,
       CASE WHEN first_id % 2 = 0
            THEN '[{{"rank": 1, "testcode": "TC_' || line || '_01", "process": "L2AR", "failed": ' || failed
                 || ', "total": ' || total || ', "rate": ' || pct_int || '}}]'
            ELSE '[{{"rank": 1, "testcode": "TC_' || line || '_01", "process": "L2AR", "failed_units": ' || failed
                 || ', "total_line": ' || total || ', "rate": ' || pct_int || '}}]' END AS top_testcodes,
       CASE WHEN dd = 13 THEN 'bad time' ELSE strftime(sent_ts, '%Y-%m-%d %H:%M:%S') END AS alert_sent_at,
       CAST(NOT (dd % 3 = 0 AND li % 2 = 0) AS INTEGER) AS resolved,
       CASE WHEN NOT (dd % 3 = 0 AND li % 2 = 0)
            THEN strftime(sent_ts + to_minutes(CAST(mins AS INTEGER)), '%Y-%m-%d %H:%M:%S') END AS resolved_at,
       CASE WHEN NOT (dd % 3 = 0 AND li % 2 = 0) THEN mins END AS resolution_mins,
       CASE WHEN NOT (dd % 3 = 0 AND li % 2 = 0) THEN CAST(mins <= 60 AS INTEGER) END AS within_sla,
       CAST(NULL AS VARCHAR) AS telegram_msg_id, d AS _day
FROM b"""


REPAIRS_SQL = """
SELECT CAST(a.id * 2 + k AS BIGINT) AS id,
       CAST(CASE WHEN k = 0 AND a.id % 5 = 0 THEN NULL WHEN k = 1 AND odd THEN NULL ELSE a.id END AS BIGINT) AS alert_id,
       CASE WHEN k = 1 AND odd THEN 'ALERT-x' ELSE 'ALERT-' || CAST(a.id AS VARCHAR) END AS unit_id,
       line, station, CASE WHEN resolved = 1 THEN 'Closed' ELSE 'Open' END AS status,
       CAST(NULL AS VARCHAR) AS failure_description,
       CASE WHEN k = 1 AND NOT odd THEN 'earlier rca ' || CAST(a.id AS VARCHAR) END AS rca_text,
       CAST(NULL AS VARCHAR) AS action_taken, CAST(NULL AS VARCHAR) AS capa_text,
       CAST(NULL AS VARCHAR) AS engineer_contact, alert_sent_at AS created_at, alert_sent_at AS updated_at,
       resolved_at AS closed_at
FROM (SELECT *, (day(_day) = 2 AND CAST(substr(line, 2) AS INTEGER) = 1 AND id % 7 <> 0) AS odd FROM alerts_src) a,
     (SELECT unnest([0, 1]) AS k) ks
WHERE k = 0 OR a.id % 7 = 0 OR odd"""


def messages_sql() -> str:
    parts = []
    for seq, kind, rule, cond in MESSAGE_RULES:
        pieces = rule.split("{id}")
        text = " || CAST(id AS VARCHAR) || ".join(f"'{p}'" for p in pieces)
        parts.append(
            f"SELECT CAST(id * 100 + {seq} AS BIGINT) AS msg_id, "
            f"CAST(_day AS TIMESTAMP) + INTERVAL 23 HOUR + to_minutes({(seq + 1) * 7}) AS ts, "
            f"'eng' || CAST(id % 3 AS VARCHAR) AS user, '{kind}' AS kind, {text} AS text "
            f"FROM alerts_src WHERE {cond}")
    return "\nUNION ALL ".join(parts)
