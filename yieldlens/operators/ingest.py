"""Raw result text -> routed records (P1-P8, F8, J6, S6, S10, ST2, ST6).

The whole parse is one projection of built-in expressions over the file
text (``split`` into lines, ``filter`` the first TH4 row with >= 18 fields,
``split`` it into fields), so it runs inside whole-stage codegen with no
Python worker. Each file's whole text is parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import columns as C


def th4_fields(content) -> Column:
    """The fields of the first line whose field 0 is exactly ``TH4`` and
    that has >= 18 fields; null when there is none."""
    lines = F.split(C.col_(content), C.LINE_BREAK, -1)
    row = F.get(F.filter(lines, lambda ln: ln.startswith("TH4,") & (F.size(F.split(ln, ",", -1)) >= 18)), 0)
    return F.split(row, ",", -1)


def failed_code(parts: Column, status: Column) -> Column:
    """Only for status ``F``: field 14 stripped, else the first of fields
    10..15 accepted by the test-code predicate, else ''."""
    f14 = C.strip_ws(F.get(parts, 14))
    scan = F.get(F.filter(F.slice(parts, 11, 6), lambda x: C.is_testcode(x)), 0)
    chosen = F.coalesce(F.when(f14 != "", f14), C.strip_ws(scan), F.lit(""))
    return F.when(status == "F", chosen).otherwise(F.lit(""))


def parse_records(files: DataFrame, content: str = "content") -> DataFrame:
    """Add the ten record fields (null when the file has no TH4 row)
    and a ``has_th4`` flag."""
    parts = F.col("_parts")
    field = lambda k: C.strip_ws(F.get(parts, k))
    ts = F.col("event_ts")
    # intermediate columns keep each sub-parse a single attribute reference
    rec = (files.withColumn("_parts", th4_fields(content))
           .withColumn("_tparts", C.result_time_parts(field(3)))
           .withColumn("event_ts", C.time_from_parts("_tparts"))).select(
        "*",
        field(1).alias("track_id"), field(4).alias("process"), field(17).alias("model"),
        C.line_from_station(field(5)).alias("line"), field(5).alias("station"),
        field(9).alias("status"), failed_code(parts, field(9)).alias("failed_tests"),
        F.date_format(ts, "yyyy-MM-dd").alias("date"), F.date_format(ts, "HH:mm:ss").alias("time"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        parts.isNotNull().alias("has_th4"))
    return rec.drop("_parts", "_tparts")


ORDER = ["file_mtime", "file_id"]


def _first_outcome(allowed: list[str] | None) -> Column:
    """P7 for the first copy of a name, over parsed rows with ``_gone``."""
    return (F.when(F.col("_gone"), K.R_FILE_GONE)
            .when(~F.col("has_th4"), K.R_NO_TH4)
            .when(~F.coalesce(F.col("process").isin(*(allowed or K.ALLOWED_PROCESSES)), F.lit(False)), K.R_PROCESS)
            .otherwise(K.INSERT))


def first_outcomes(files: DataFrame, content: str = "content", order: list[str] | None = None,
                   allowed: list[str] | None = None) -> DataFrame:
    """filename, outcome, event_ts, source of the first copy of every name and its number of ``copies``: what
    ``route`` gives but for its DUPLICATE rows, as one aggregate without a join."""
    rec = parse_records(files, content).withColumn("_gone", F.col(content).isNull())
    rec = rec.select("filename", F.struct(*(order or ORDER)).alias("_key"),
                     F.struct(_first_outcome(allowed).alias("outcome"), "event_ts", "source").alias("_r"))
    return (rec.groupBy("filename").agg(F.min_by("_r", "_key").alias("_r"), F.count(F.lit(1)).alias("copies"))
            .select("filename", "_r.*", "copies"))


def route(files: DataFrame, content: str = "content", order: list[str] | None = None,
          allowed: list[str] | None = None) -> DataFrame:
    """P7 + F8 + ST2: one ``outcome`` per file: INSERT, PROCESS_SKIP, NO_TH4,
    FILE_GONE (text could not be read) or DUPLICATE (the file name was seen
    before, in ``order``; Q16).

    The text is parsed once and dropped. The first copy of every name is an
    aggregate over the names and the order columns alone (the text is pruned
    from that branch; a name with a huge number of copies is reduced before
    the shuffle), joined back on the name; AQE splits the join if one name
    holds many rows. Nothing runs before the caller's action."""
    order = order or ORDER
    rec = (parse_records(files, content)
           .withColumn("_gone", F.col(content).isNull()).drop(content))
    first = (files.groupBy("filename").agg(F.min(F.struct(*order)).alias("_first_key")))
    rec = rec.join(first, "filename", "left")
    dup = F.struct(*[F.col(c) for c in order]) != F.col("_first_key")
    outcome = F.when(dup, K.R_DUPLICATE).otherwise(_first_outcome(allowed))
    name_track = C.track_from_filename(F.col("filename"))
    return (rec.withColumn("outcome", outcome)
            .withColumn("track_id", F.when(F.col("outcome").isin(K.R_NO_TH4, K.R_FILE_GONE), name_track)
                        .otherwise(F.col("track_id")))
            .drop("_first_key", "has_th4", "_gone"))


def records(routed: DataFrame, *more: str) -> DataFrame:
    """The INSERT rows as ``log_data`` columns (``failed_tests`` is stored
    as ``failed_testcode``), and ``more`` columns of the routed rows."""
    return (routed.where(F.col("outcome") == K.INSERT)
            .select("filename", "source", "process", "model", "line", "station", "status",
                    F.col("failed_tests").alias("failed_testcode"), "track_id", "date", "time", "timestamp",
                    "event_ts", *more))


def skip_log(routed: DataFrame) -> DataFrame:
    """``skip_log`` rows: PROCESS_SKIP and PARSE_ERROR (NO_TH4, FILE_GONE and
    DUPLICATE have their own tables, as in the reproduced system)."""
    return (routed.where(F.col("outcome").isin(K.R_PROCESS, K.R_PARSE_ERR))
            .select("filename", F.col("outcome").alias("reason"),
                    F.coalesce("process", F.lit("")).alias("process"),
                    F.coalesce("track_id", F.lit("")).alias("track_id"),
                    F.when(F.col("timestamp") != "", F.col("timestamp")).alias("timestamp"),
                    "event_ts"))


def late_caught(routed: DataFrame, lag_seconds: int | None = None,
                processed_at: Column | None = None) -> DataFrame:
    """ST6: inserted records whose file was found by poll/rescan; with
    ``lag_seconds`` the Spark form: processing time - file mtime above a
    bound (Spark has one detector, so the source tag is replaced by lag)."""
    ins = routed.where(F.col("outcome") == K.INSERT)
    if lag_seconds is None:
        cond = F.col("source").isin(*K.LATE_SOURCES)
    else:
        now = processed_at if processed_at is not None else F.current_timestamp().cast("timestamp_ntz")
        cond = F.timestamp_diff("SECOND", F.col("file_mtime"), now) > lag_seconds
    return ins.where(cond).select("filename", "track_id", "process")


# --- P8 envelope -------------------------------------------------------------

def to_envelope(rec: DataFrame) -> DataFrame:
    """key = track id, value = JSON of the record + ``_filename`` and ``_source``."""
    fields = [F.col(f) for f in K.RECORD_FIELDS]
    return rec.select(F.col("track_id").alias("key"),
                      F.to_json(F.struct(*fields, F.col("filename").alias("_filename"),
                                         F.col("source").alias("_source"))).alias("value"))


def from_envelope(df: DataFrame, value: str = "value") -> DataFrame:
    """Decode; rows whose value is not a JSON object get ``bad_json``. Columns beside the
    value (key, offset, ...) are kept, and a bad row keeps its text as ``raw``."""
    raw = F.col(value).cast("string")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))
    out = df.select(*[F.col(c) for c in df.columns if c != value], raw.alias("_raw"),
                    F.from_json(raw, K.ENVELOPE, {"mode": "PERMISSIVE"}).alias("_e"), (~is_object).alias("bad_json"))
    kept = [F.col(c) for c in df.columns if c != value and c not in (*K.RECORD_FIELDS, "filename", "source")]
    return out.select(*kept, *[F.col(f"_e.{f}").alias(f) for f in K.RECORD_FIELDS],
                      F.coalesce(F.col("_e._filename"), F.lit("")).alias("filename"),
                      F.coalesce(F.col("_e._source"), F.lit("unknown")).alias("source"),
                      "bad_json", F.when(F.col("bad_json"), F.col("_raw")).alias("raw"))


def from_relay(decoded: DataFrame, order: list[str]) -> DataFrame:
    """S4 consumer side: decoded envelopes as routed rows. The first copy of a file name in
    ``order`` is an INSERT, later ones are duplicates; bad rows are left to the dead letters. A record without a
    file name is no copy of another: it is known by its place in ``order``."""
    place = F.concat_ws("/", *(F.col(c).cast("string") for c in order))
    good = decoded.where(~F.col("bad_json")).withColumn(
        "_name", F.when(F.col("filename") != "", F.concat(F.lit("n"), "filename")).otherwise(place))
    first = good.groupBy("_name").agg(F.min(F.struct(*order)).alias("_first_key"))
    copy = F.struct(*[F.col(c) for c in order]) != F.col("_first_key")
    return (good.join(first, "_name")
            .withColumn("outcome", F.when(copy, K.R_DUPLICATE).otherwise(K.INSERT))
            .withColumn("file_id", F.col("_name"))
            .withColumn("event_ts", C.parse_iso_ts(F.col("timestamp"))).drop("_name", "_first_key", "bad_json", "raw"))


# --- J6 / S10: processed-file register -------------------------------------

def register_latest(register: DataFrame) -> DataFrame:
    """File name -> latest processed time (append-only register)."""
    return register.groupBy("filename").agg(F.max("processed_time").alias("processed_time"))


def unprocessed(files: DataFrame, register: DataFrame) -> DataFrame:
    """Files whose name is not in the register (anti join)."""
    return files.join(register.select("filename").distinct(), "filename", "left_anti")
