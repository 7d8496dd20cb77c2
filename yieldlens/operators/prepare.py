"""Turn the fact table into a dashboard frame.

Three profiles, one per dashboard of the reproduced system:

* ``tests``   test-level quality (status P/F/Unknown, null tokens cleaned,
              blank code kept as '')
* ``span``    track classification by failure time span (status text F or FAILED fails,
              unknown statuses count as passed, blank code -> MISSING_CODE)
* ``pattern`` test-level NTF / Real Fail by failure-code words

All three parse the row's own ``timestamp`` and drop rows where it does not
parse. Output columns: ``id track_id model line station process status
failed_testcode event_ts date hour tod failed status_display``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import columns as C

PROFILES = ("tests", "span", "pattern")

# Mapping by name for inputs whose columns are named differently.
DEFAULT_MAPPING: dict[str, str] = {}


def map_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """P18 (Q1): rename by name, never by position."""
    return df.withColumnsRenamed(mapping) if mapping else df


def _label(profile: str, status: Column, code: Column) -> Column:
    if profile == "tests":
        return (F.when(status == "P", K.PASSED).when(status == "F", K.FAILED)
                .otherwise(K.UNKNOWN))
    if profile == "span":
        return F.when(status == "FAILED", K.FAILED).otherwise(K.PASSED)
    failed = F.coalesce(status == "FAILED", F.lit(False))
    return (F.when(~failed, K.PASSED).when(C.ntf_code(code), K.NTF)
            .otherwise(K.REAL_FAIL))


def prepare(facts: DataFrame, profile: str = "tests", columns: dict[str, str] | None = None) -> DataFrame:
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    df = map_columns(facts, columns)
    status = F.upper(C.strip_ws(F.col("status")))
    if profile == "tests":
        dims = {c: C.null_if_token(C.strip_ws(F.col(c)), K.NULL_TOKENS_TESTS)
                for c in ["model", "line", "station", "process", "failed_testcode"]}
        model = F.coalesce(dims["model"], F.lit(K.UNKNOWN))
        code = F.coalesce(dims["failed_testcode"], F.lit(""))
        line, station, process = dims["line"], dims["station"], dims["process"]
    else:
        model = F.coalesce(C.null_if_token(F.col("model"), K.MODEL_NULL_TOKENS), F.lit(K.UNKNOWN))
        raw_code = F.coalesce(F.col("failed_testcode"), F.lit(""))
        code = F.when(raw_code.isin(*K.CODE_NULL_TOKENS), F.lit(K.MISSING_CODE)).otherwise(raw_code)
        line, station, process = F.col("line"), F.col("station"), F.col("process")
        status = F.when(status == "P", "PASSED").when(status == "F", "FAILED").otherwise(status)
    # stored facts carry the parsed time and its date: a date filter then selects folders. Their time may also come
    # from date and time, so rows without a timestamp of their own still go
    stored = {"event_ts", "event_date"} <= set(df.columns)
    ts = F.col("event_ts") if stored else C.parse_iso_ts(F.col("timestamp"))
    if stored:
        df = df.where(F.trim("timestamp") != "")
    out = (df.select(
        F.col("id"), F.col("track_id"), model.alias("model"), line.alias("line"),
        station.alias("station"), process.alias("process"), status.alias("status"),
        code.alias("failed_testcode"), ts.alias("event_ts"),
        (F.col("event_date") if stored else F.to_date(ts)).alias("date"))
        .where(F.col("event_ts").isNotNull()))
    return out.select(
        *(c for c in out.columns if c != "date"), "date",
        F.hour("event_ts").cast("long").alias("hour"),
        C.micros_of_day("event_ts").alias("tod"),
        F.coalesce(F.col("status") == ("F" if profile == "tests" else "FAILED"), F.lit(False)).alias("failed"),
        _label(profile, F.col("status"), F.col("failed_testcode")).alias("status_display"))
