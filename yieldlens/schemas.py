"""Schemas of the fact and audit tables, and the fixed value lists.

The value lists below must equal the ones of the system we reproduce for the
results to match; they are stated here once, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must match the reproduced system exactly)
# ---------------------------------------------------------------------------
# Processes whose records are inserted; everything else is PROCESS_SKIP.
ALLOWED_PROCESSES = ["L2AR", "L2VISION", "UCT", "FOD", "DepthVal", "DepthCal"]

# Skip / outcome reasons.
R_NO_TH4 = "NO_TH4"
R_PROCESS = "PROCESS_SKIP"
R_DUPLICATE = "DUPLICATE"
R_FILE_GONE = "FILE_GONE"
R_PARSE_ERR = "PARSE_ERROR"
SKIP_REASONS = [R_NO_TH4, R_PROCESS, R_DUPLICATE, R_FILE_GONE, R_PARSE_ERR]
INSERT = "INSERT"
# Reason columns of the hourly gap report, in report order.
HOURLY_GAP_REASONS = [R_NO_TH4, R_PROCESS, R_FILE_GONE, R_PARSE_ERR]

# Detection sources of a file.
SOURCES = ["watchdog", "poll", "rescan", "startup"]
LATE_SOURCES = ["rescan", "poll"]

# Test-code predicate: geography suffixes, skip values, keyword alternation.
GEO_SUFFIXES = ["INDIA", "CHINA", "USA", "JAPAN", "KOREA", "GLOBAL",
                "EUROPE", "LATAM", "APAC", "ROW", "EMEA", "DOMESTIC", "EXPORT"]
TESTCODE_SKIP_VALUES = ["(NULL)", "NULL", "NONE", "*", "N/A"]
TESTCODE_KEYWORDS = ("STATUS|RSSI|LEAKAGE|BLEMISH|CHARGE|WIFI|GPS|NFC|"
                     "SENSOR|AUDIO|CAMERA|LIGHT|BATTERY|DISPLAY|TOUCH|ANTENNA|"
                     "FIRMWARE|DOWNLOAD|COMPLETE|DETECT|VERIFY|CONNECT|ACTIVITY|"
                     "FREQ|OFFSET|CARRIER|NOISE|HEADSET|LEVEL|RESULT|REGION|"
                     "BARCODE|BOOT|CALIBR|FLASH|REBOOT|UNLOCK|LOCK|READ|WRITE")

# Failure-code words that mark a failed test as "no trouble found".
NTF_PATTERNS = ["BARCODE", "BAD_OR_FAILED", "NO DATA", "NOT FOUND",
                "UNCOVERED", "TIMEOUT", "NULL", "MISSING", "FAILED_BARCODE",
                "COMMUNICATION", "HARDWARE_NOT_DETECTED", "CALIBRATION_REQUIRED"]
MISSING_CODE = "MISSING_CODE"

# Status spellings that mean failure in alerting.
ALERT_FAIL_STATUSES = ["F", "FAIL", "FAILED"]

# Null-like text tokens of the test-level dashboard, and of the other two.
NULL_TOKENS_TESTS = ["None", "NULL", "nan", ""]
MODEL_NULL_TOKENS = ["No Data Found", "NULL", ""]
CODE_NULL_TOKENS = ["NULL", "None", ""]

# Engineer reply prefixes -> repair field, in match order.
REPLY_FIELDS = [("RCA:", "rca_text"), ("ACTION:", "action_taken"),
                ("CAPA:", "capa_text"), ("DESC:", "failure_description")]
RESPONSE_FIELDS = ["rca_text", "action_taken", "capa_text", "failure_description"]

# Shift presets (time of day, both ends inclusive).
SHIFT_PRESETS = {"Day": ("00:00:00", "23:59:00"),
                 "AM": ("06:00:00", "14:00:00"),
                 "PM": ("14:00:00", "22:00:00")}

# Notification and view texts (fixed layout of the reproduced messages).
# ``{name}`` fields are filled per alert; ``{bar}`` / ``{rule}`` are the
# 40-character separators; ``{codes}`` is the block of ranked codes.
ALERT_MESSAGE = (
    "⚠️  LINE FAILURE ALERT\n"
    "{bar}\n"
    "Line         : {line}\n"
    "Station      : {station}\n"
    "Failure Rate : {rate}%   (threshold >{threshold}%)\n"
    "Failed/Total : {failed}/{total}  (last {window}min, dedup by unit)\n"
    "Alert ID     : #{id}\n"
    "Time         : {time}\n"
    "SLA          : {sla}h\n"
    "{rule}\n"
    "🔴 Top Failed Test Codes:\n"
    "{codes}"
    "{rule}\n"
    "Reply with:\n"
    "  RCA:{id}:<root cause>\n"
    "  ACTION:{id}:<action taken>\n"
    "  CAPA:{id}:<corrective steps>\n"
    "  RESOLVE:{id}\n"
    "Photo: send image, caption=IMG:{id}:<note>\n"
    "Or tap a button below ↓"
)
ALERT_BAR = "═" * 40
ALERT_RULE = "─" * 40
ALERT_CODE_LINE = ("\n  {rank}. TestCode : {testcode}\n     Process  : {process}\n"
                   "     Failed   : {failed}/{total} ({rate}%)\n")
ALERT_NO_CODES = "\n  (no testcode data in window)\n"
OPEN_VIEW_CODE_LINE = "\n    {rank}. {testcode} {rate}% ({failed}/{total})"
SLA_BREACH = "🔴 SLA BREACH"
SLA_AGE = "{age}m/{sla}m"
NOT_FILLED = "❌ not filled"
DASH = "—"
ICON_WITHIN_SLA = "✅"
ICON_SLA_BREACHED = "🔴"

# Alerting defaults.
FAILURE_THRESHOLD = 3.0
MIN_SAMPLES = 5
TOP_N_LINES = 3
TOP_N_TESTCODES = 3
SLA_HOURS = 1
WINDOW_MINUTES = 240
POLL_SECONDS = 1800

# Span limits of the two classification dashboards.
SPAN_LIMIT_TRACKS = 60
SPAN_LIMIT_PATTERN = 30

# Status labels.
PASSED, FAILED, UNKNOWN, NTF, REAL_FAIL = "Passed", "Failed", "Unknown", "NTF", "Real Fail"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
S = T.StringType()

LOG_DATA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("process", S), T.StructField("model", S),
    T.StructField("line", S), T.StructField("station", S),
    T.StructField("status", S), T.StructField("failed_testcode", S),
    T.StructField("track_id", S),
    T.StructField("date", S), T.StructField("time", S), T.StructField("timestamp", S),
])

# The ten fields of one parsed TH4 record.
RECORD_FIELDS = ["track_id", "process", "model", "line", "station", "status",
                 "failed_tests", "date", "time", "timestamp"]
RECORD = T.StructType([T.StructField(f, S) for f in RECORD_FIELDS])
ENVELOPE = T.StructType(RECORD.fields + [T.StructField("_filename", S),
                                         T.StructField("_source", S)])

RECONCILIATION_CSV = T.StructType([T.StructField(c, S) for c in
                                   ["Track_ID", "Process", "Station", "Date", "Time", "Reason"]])

TOP_CODE = T.StructType([
    T.StructField("rank", T.LongType()), T.StructField("testcode", S),
    T.StructField("process", S), T.StructField("failed_units", T.LongType()),
    T.StructField("total_line", T.LongType()), T.StructField("rate", T.DoubleType()),
])
# Reader schema also accepts the older key names ``failed`` / ``total``.
TOP_CODE_READ = T.ArrayType(T.StructType(TOP_CODE.fields + [
    T.StructField("failed", T.LongType()), T.StructField("total", T.LongType())]))

FAILURE_ALERTS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("source_table", S),
    T.StructField("line", S), T.StructField("station", S),
    T.StructField("line_failure_rate", T.DoubleType()),
    T.StructField("total_tests", T.LongType()), T.StructField("failed_tests", T.LongType()),
    T.StructField("top_testcodes", S), T.StructField("alert_sent_at", S),
    T.StructField("resolved", T.IntegerType()), T.StructField("resolved_at", S),
    T.StructField("resolution_mins", T.DoubleType()), T.StructField("within_sla", T.IntegerType()),
    T.StructField("telegram_msg_id", S),
])

REPAIR_ACTIONS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("alert_id", T.LongType()),
    T.StructField("unit_id", S), T.StructField("line", S), T.StructField("station", S),
    T.StructField("status", S), T.StructField("failure_description", S),
    T.StructField("rca_text", S), T.StructField("action_taken", S),
    T.StructField("capa_text", S), T.StructField("engineer_contact", S),
    T.StructField("created_at", S), T.StructField("updated_at", S), T.StructField("closed_at", S),
])

REPAIR_MEDIA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("repair_id", T.LongType()),
    T.StructField("alert_id", T.LongType()), T.StructField("filepath", S),
    T.StructField("caption", S), T.StructField("uploaded_by", S),
    T.StructField("media_type", S), T.StructField("uploaded_at", S),
])

MESSAGES = T.StructType([
    T.StructField("msg_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user", S), T.StructField("kind", S), T.StructField("text", S),
])
