"""Registered streaming queries: each runs the stream with ``availableNow``
into a fresh folder under the session's checkpoint directory and returns the
table it produced; queries that read different tables of one job share its run.
The oracle is the batch SQL of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as K
from ..operators import alerting as A
from ..operators import filters as FL
from ..operators import reports as R
from ..operators.dedup import latest_per_track, with_event_ts
from ..operators.prepare import prepare
from ..session import scratch, tune_for_parsing
from ..sources import fixtures as fx
from ..sources.files import read_table
from ..streaming import ingest as SI
from ..streaming import line_rates as SL
from ..streaming import state as ST
from . import common as Q
from .alerting import _LINE_COUNTS, _RATE
from . import lifecycle as LC
from .common import with_ctes
from .dashboards import detail_sql
from .ingest import ingest_ctes


HALF = "2024-01-16 00:00:00"


_REC_COLS = ["filename", "source", "process", "model", "line", "station", "status", "failed_testcode",
             "track_id", "date", "time", "timestamp"]


_RUNS: dict[tuple[str, str, str], str] = {}


def _once(job):
    """A job whose tables several queries read runs once for a session and input."""
    def run(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir, job.__name__)
        if key not in _RUNS:
            _RUNS[key] = job(spark, sf_dir)
        return _RUNS[key]
    return run


@_once
def _ingested(spark, sf_dir):
    """The root of an ingest job that took all result files in one run."""
    tune_for_parsing(spark)
    base = scratch(spark)
    fx.raw_files(spark, sf_dir).write.parquet(f"{base}/input")
    q = SI.start_ingest(SI.stream_raw_rows(spark, f"{base}/input", max_files=4), f"{base}/out",
                        f"{base}/ckpt", trigger={"availableNow": True})
    q.awaitTermination()
    return f"{base}/out"


def _in_turns(frames, path, start):
    """Add each frame to the stream's folder and run the query on it until it has caught up."""
    for frame in frames:
        frame.write.mode("append").parquet(path)
        start().awaitTermination()


@_once
def _ingested_in_turns(spark, sf_dir):
    """As ``_ingested``, in two runs by the files' time."""
    tune_for_parsing(spark)
    base = scratch(spark)
    raw = fx.raw_files(spark, sf_dir)
    early = F.coalesce(F.dayofmonth("file_mtime") <= 15, F.lit(False))
    _in_turns([raw.where(early), raw.where(~early)], f"{base}/input", lambda: SI.start_ingest(
        SI.stream_raw_rows(spark, f"{base}/input", schema=raw.schema), f"{base}/out", f"{base}/ckpt", {"availableNow": True}))
    return f"{base}/out"


def stream_ingest(spark, sf_dir):
    return read_table(spark, _ingested(spark, sf_dir), "log_data").select(*_REC_COLS)


def stream_gone_files(spark, sf_dir):
    """Files whose text could not be read, as the ingest job records them."""
    return read_table(spark, _ingested(spark, sf_dir), "file_gone_log")


def ingested_code_detail(spark, sf_dir):
    """A9 over ingested facts: the example of a code is its first row by insertion."""
    facts = read_table(spark, _ingested_in_turns(spark, sf_dir), "log_data")
    return R.code_detail(FL.FilterSpec().apply(prepare(facts, "tests")), 20)


def ingested_ids(spark, sf_dir):
    """Facts in the order of their insertion."""
    return read_table(spark, _ingested_in_turns(spark, sf_dir), "log_data").select("id", "filename", "track_id")


def ingested_lines_above_threshold(spark, sf_dir):
    """Raw files -> stream -> stored fact table -> W1 + A31."""
    facts = read_table(spark, _ingested(spark, sf_dir), "log_data")
    return A.line_rates(latest_per_track(facts, Q.ASOF, Q.WINDOW), Q.MIN_SAMPLES, Q.THRESHOLD, Q.TOP_LINES)


def _facts_and_end(spark, sf_dir):
    """The facts with ``event_ts``, and a last row, without a line, far enough ahead to close every window of theirs."""
    facts = with_event_ts(Q.facts(spark, sf_dir)).select(*K.LOG_DATA.fieldNames(), "event_ts")
    end = (facts.agg(F.max("event_ts").alias("_t"))
           .select(*[(F.date_format(F.col("_t") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd HH:mm:ss")
                      if f.name == "timestamp" else F.lit(None)).cast(f.dataType).alias(f.name)
                     for f in K.LOG_DATA.fields]))
    return facts, end


def _fact_stream(spark, sf_dir, base):
    facts, end = _facts_and_end(spark, sf_dir)
    facts.drop("event_ts").unionByName(end).write.parquet(f"{base}/facts")
    return spark.readStream.schema(K.LOG_DATA).parquet(f"{base}/facts")


def stream_line_rate(spark, sf_dir):
    base = scratch(spark)
    stream = _fact_stream(spark, sf_dir, base)
    q = SL.start_line_rates(stream, f"{base}/rates", f"{base}/ckpt", trigger={"availableNow": True})
    q.awaitTermination()
    return spark.read.parquet(f"{base}/rates")


@_once
def _alerted(spark, sf_dir):
    base = scratch(spark)
    stream = _fact_stream(spark, sf_dir, base)
    SL.start_alerts(stream, f"{base}/state", f"{base}/ckpt", trigger={"availableNow": True}, min_samples=Q.MIN_SAMPLES,
                    threshold=Q.THRESHOLD, k=Q.TOP_LINES).awaitTermination()
    return f"{base}/state"


def _stream_alerts(name):
    return lambda spark, sf_dir: SL.alert_table(spark, _alerted(spark, sf_dir), name)


def stream_alerts_after_resolve(spark, sf_dir):
    """ST8 + L5: the alerts of the first half of the month are resolved by messages, then the second half comes."""
    base = scratch(spark)
    facts, end = _facts_and_end(spark, sf_dir)
    half = F.col("event_ts") < F.lit(HALF).cast("timestamp_ntz")
    halves = [facts.where(half).drop("event_ts"), facts.where(~F.coalesce(half, F.lit(False))).drop("event_ts").unionByName(end)]

    def start():
        return SL.start_alerts(spark.readStream.schema(K.LOG_DATA).parquet(f"{base}/facts"), f"{base}/state", f"{base}/ckpt",
                               trigger={"availableNow": True}, min_samples=Q.MIN_SAMPLES, threshold=Q.THRESHOLD, k=Q.TOP_LINES)

    _in_turns(halves[:1], f"{base}/facts", start)
    opened = SL.alert_table(spark, f"{base}/state", "failure_alerts").where("resolved = 0")
    done = opened.select(F.col("id").alias("msg_id"), F.lit(HALF).cast("timestamp_ntz").alias("ts"), F.lit("eng").alias("user"),
                         F.lit("text").alias("kind"), F.concat(F.lit("RESOLVE:"), F.col("id").cast("string")).alias("text"))
    ST.message_batch(done, 0, f"{base}/state")
    _in_turns(halves[1:], f"{base}/facts", start)
    return SL.alert_table(spark, f"{base}/state", "failure_alerts")


@_once
def _handled(spark, sf_dir):
    """The messages as a stream, in two runs by their time, against the stored state."""
    base = scratch(spark)
    alerts_x = fx.alert_state(Q.facts(spark, sf_dir))
    alerts_x.write.parquet(f"{base}/alerts")
    alerts_x = spark.read.schema(alerts_x.schema).parquet(f"{base}/alerts")
    ST.seed(ST.state_store(spark, f"{base}/state"), alerts_x.drop("_day"), fx.repair_state(alerts_x))
    messages = fx.messages(alerts_x)
    early = F.col("ts") < F.lit("2024-01-15 23:30:00").cast("timestamp_ntz")
    _in_turns([messages.where(early), messages.where(~early)], f"{base}/messages", lambda: ST.start_messages(
        spark.readStream.schema(K.MESSAGES).parquet(f"{base}/messages"), f"{base}/state", f"{base}/ckpt", {"availableNow": True}))
    return f"{base}/state"


def _stream_lifecycle(name):
    def run(spark, sf_dir):
        store = ST.state_store(spark, _handled(spark, sf_dir))
        return store.newest(name) if ST.TABLES[name].key else store.read(name)
    return run


def stream_late_rates(spark, sf_dir):
    """ST9: every 50th row arrives after its windows were closed; their windows are evaluated again."""
    base = scratch(spark)
    facts, end = _facts_and_end(spark, sf_dir)
    late = F.col("id") % 50 == 0
    turns = [facts.where(~late).drop("event_ts").unionByName(end), facts.where(late).drop("event_ts")]

    def start():
        stream = spark.readStream.schema(K.LOG_DATA).parquet(f"{base}/facts")
        SL.start_line_rates(stream, f"{base}/rates", f"{base}/ckpt", trigger={"availableNow": True}).awaitTermination()
        return SL.start_late_rows(stream, f"{base}/late", f"{base}/ckpt2", {"availableNow": True}, within_batch=False)

    _in_turns(turns, f"{base}/facts", start)
    kept = SL.late_store(spark, f"{base}/late").read("late_rows")
    return SL.settled_rates(spark.read.parquet(f"{base}/rates"), kept, spark.read.schema(K.LOG_DATA).parquet(f"{base}/facts"))


QUERIES = {
    "stream_alerts_after_resolve": stream_alerts_after_resolve,
    "stream_lifecycle_alerts": _stream_lifecycle("failure_alerts"),
    "stream_lifecycle_repairs": _stream_lifecycle("repair_actions"),
    "stream_lifecycle_media": _stream_lifecycle("repair_media"),
    "stream_lifecycle_rejected": _stream_lifecycle("rejected_messages"),
    "stream_late_rates": stream_late_rates,
    "stream_gone_files": stream_gone_files,
    "ingested_code_detail": ingested_code_detail,
    "ingested_ids": ingested_ids,
    "stream_ingest": stream_ingest,
    "stream_line_rate": stream_line_rate,
    "stream_alerts": _stream_alerts("failure_alerts"),
    "stream_alert_repairs": _stream_alerts("repair_actions"),
    "ingested_lines_above_threshold": ingested_lines_above_threshold,
}

_TRACKED = "track_id IS NOT NULL AND TRIM(track_id) <> ''"
_WINDOW_CTES = with_ctes(Q.log_cte(), Q.alert_facts_cte(), ("ev", "SELECT * FROM facts WHERE event_ts IS NOT NULL"),
                       ("win", """SELECT ev.*, time_bucket(INTERVAL 30 MINUTE, event_ts) - to_minutes(30 * k) AS ws
                                  FROM ev, (SELECT unnest(range(8)) AS k) ks"""),
                       ("keyed", f"""SELECT *, CASE WHEN {_TRACKED} THEN track_id ELSE chr(0) || CAST(id AS VARCHAR) END
                                     AS key FROM win WHERE event_ts < ws + INTERVAL 240 MINUTE"""),
                       ("latest", """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ws, key
                                     ORDER BY event_ts DESC, id DESC) AS rn FROM keyed) WHERE rn = 1"""))
_LINE_RATE = _WINDOW_CTES + f"""
SELECT ws AS window_start, ws + INTERVAL 240 MINUTE AS window_end, line, COUNT(*) AS total,
       CAST(SUM(CASE WHEN {Q.FAIL_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS failed
FROM latest GROUP BY ws, line"""

_RAW = "failed * CAST(100.0 AS DOUBLE) / total"


def _alerted_sql(phase: str = "1") -> str:
    """Per window the top lines above the threshold; in each phase a line's alert opens in its first such window."""
    return _WINDOW_CTES + f"""
, phased AS (SELECT *, {phase} AS phase FROM latest)
, rates AS (SELECT phase, ws, line, COUNT(*) AS total, CAST(SUM(CASE WHEN {Q.FAIL_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS failed
            FROM phased GROUP BY phase, ws, line)
, breach AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ws ORDER BY {_RAW} DESC, line) AS rk FROM rates
             WHERE total >= {Q.MIN_SAMPLES} AND {_RAW} > {Q.THRESHOLD})
, opened AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY phase, line ORDER BY ws) AS nth FROM breach
                            WHERE rk <= {Q.TOP_LINES}) WHERE nth = 1)
, here AS (SELECT l.* FROM phased l JOIN opened o ON l.ws = o.ws AND l.line = o.line)
, per_code AS (SELECT phase, line, TRIM(split_part(failed_testcode, ';', 1)) AS code, process, COUNT(*) AS failed_units FROM here
               WHERE {Q.FAIL_SQL} AND failed_testcode IS NOT NULL AND TRIM(failed_testcode) <> '' GROUP BY 1, 2, 3, 4)
, ranked AS (SELECT c.*, o.total, ROW_NUMBER() OVER (PARTITION BY c.phase, c.line ORDER BY failed_units DESC, code, process NULLS LAST)
             AS rank FROM per_code c JOIN opened o USING (phase, line))
, cj AS (SELECT phase, line, CAST(to_json(list_sort(list({{'rank': CAST(rank AS BIGINT), 'testcode': COALESCE(NULLIF(code, ''), 'UNKNOWN'),
                'process': COALESCE(process, 'N/A'), 'failed_units': failed_units, 'total_line': total,
                'rate': round_even(CAST(failed_units AS DOUBLE) / total * 100, 1)}}))) AS VARCHAR) AS codes
         FROM ranked WHERE rank <= {K.TOP_N_TESTCODES} GROUP BY phase, line)
, st AS (SELECT * FROM (SELECT phase, line, station, ROW_NUMBER() OVER (PARTITION BY phase, line ORDER BY COUNT(*) DESC, station NULLS LAST) AS rn
                        FROM here WHERE {Q.FAIL_SQL} GROUP BY phase, line, station) WHERE rn = 1)
, numbered AS (SELECT o.*, cj.codes, COALESCE(st.station, o.line) AS station, round_even({_RAW}, 2) AS rate,
                      strftime(o.ws + INTERVAL 240 MINUTE, '%Y-%m-%d %H:%M:%S') AS sent_at,
                      ROW_NUMBER() OVER (ORDER BY o.phase, o.ws, round_even({_RAW}, 2) DESC, o.line) AS n
               FROM opened o LEFT JOIN cj ON cj.line = o.line AND cj.phase = o.phase
               LEFT JOIN st ON st.line = o.line AND st.phase = o.phase)"""


_ALERTED = _alerted_sql()
# the first phase ends with the windows that the first half's newest row has closed
_TWO_PHASES = _alerted_sql(f"""(CASE WHEN ws + INTERVAL 480 MINUTE <=
    (SELECT MAX(event_ts) FROM facts WHERE event_ts < TIMESTAMP '{HALF}') THEN 1 ELSE 2 END)""")
_MINUTES = f"round_even(CAST(date_diff('second', ws + INTERVAL 240 MINUTE, TIMESTAMP '{HALF}') AS DOUBLE) / 60, 1)"
_AFTER_RESOLVE = _TWO_PHASES + f"""
SELECT n AS id, 'log_data' AS source_table, line, station, rate AS line_failure_rate, total AS total_tests,
       failed AS failed_tests, COALESCE(codes, '[]') AS top_testcodes, sent_at AS alert_sent_at,
       CAST(phase = 1 AS INTEGER) AS resolved, CASE WHEN phase = 1 THEN '{HALF}' END AS resolved_at,
       CASE WHEN phase = 1 THEN {_MINUTES} END AS resolution_mins,
       CASE WHEN phase = 1 THEN CAST({_MINUTES} <= {K.SLA_HOURS * 60} AS INTEGER) END AS within_sla,
       CAST(NULL AS VARCHAR) AS telegram_msg_id FROM numbered"""
_STREAM_ALERTS = _ALERTED + """
SELECT n AS id, 'log_data' AS source_table, line, station, rate AS line_failure_rate, total AS total_tests,
       failed AS failed_tests, COALESCE(codes, '[]') AS top_testcodes, sent_at AS alert_sent_at, CAST(0 AS INTEGER) AS resolved,
       CAST(NULL AS VARCHAR) AS resolved_at, CAST(NULL AS DOUBLE) AS resolution_mins,
       CAST(NULL AS INTEGER) AS within_sla, CAST(NULL AS VARCHAR) AS telegram_msg_id FROM numbered"""
_STREAM_REPAIRS = _ALERTED + """
SELECT n AS id, n AS alert_id, 'ALERT-' || CAST(n AS VARCHAR) AS unit_id, line, station, 'Open' AS status,
       CAST(NULL AS VARCHAR) AS failure_description, CAST(NULL AS VARCHAR) AS rca_text,
       CAST(NULL AS VARCHAR) AS action_taken, CAST(NULL AS VARCHAR) AS capa_text,
       CAST(NULL AS VARCHAR) AS engineer_contact, sent_at AS created_at, sent_at AS updated_at,
       CAST(NULL AS VARCHAR) AS closed_at FROM numbered"""

# facts as the ingest job inserts them
_INGESTED = ("ingested", """SELECT ROW_NUMBER() OVER (ORDER BY file_mtime, file_id) AS id, filename, track_id, process, model, line, station,
       status, failed_tests AS failed_testcode, date, time, timestamp FROM routed WHERE outcome = 'INSERT'""")

ORACLES = {
    "stream_alerts_after_resolve": _AFTER_RESOLVE,
    "stream_lifecycle_alerts": LC.ORACLES["resolve_alerts"],
    "stream_lifecycle_repairs": LC.HANDLED_REPAIRS,
    "stream_lifecycle_media": LC.ORACLES["attach_media"],
    "stream_lifecycle_rejected": LC.REJECTED,
    "stream_late_rates": _LINE_RATE,
    "stream_gone_files": ingest_ctes() + "SELECT filename, track_id, source FROM routed WHERE outcome = 'FILE_GONE'",
    "ingested_code_detail": ingest_ctes(
        _INGESTED, ("prep", Q.prep_sql("tests").replace("FROM log_data", "FROM ingested")),
        ("filt", f"SELECT * FROM prep WHERE {Q.DEFAULT_FILTER_SQL}")) + detail_sql(20, "failed AND failed_testcode <> ''"),
    "ingested_ids": ingest_ctes(_INGESTED) + "SELECT id, filename, track_id FROM ingested",
    "stream_alerts": _STREAM_ALERTS,
    "stream_alert_repairs": _STREAM_REPAIRS,
    "stream_ingest": ingest_ctes() + f"SELECT {', '.join(_REC_COLS)} FROM records",
    "stream_line_rate": _LINE_RATE,
    "ingested_lines_above_threshold": ingest_ctes(
        ("facts", f"SELECT *, row_number() OVER () AS id, {Q.iso_ts_sql('timestamp')} AS event_ts FROM records"),
        *Q.latest_cte()) + f"""
SELECT line, total, failed, round_even({_RATE}, 2) AS rate FROM ({_LINE_COUNTS})
WHERE total >= {Q.MIN_SAMPLES} AND {_RATE} > {Q.THRESHOLD} ORDER BY {_RATE} DESC, line LIMIT {Q.TOP_LINES}""",
}
