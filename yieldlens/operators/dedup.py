"""Latest row per track inside a trailing window.

Rows with a track id keep only their newest row (time desc, id desc);
rows without one (null or blank) are all kept, unshuffled. The keyed side is
reduced by an aggregate rather than a window: the aggregate combines map-side,
so a track that holds a third of all rows is reduced per input partition
before the shuffle instead of being sorted whole in one task.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

DEDUP_COLS = ["id", "track_id", "line", "station", "status", "failed_testcode", "process"]


def cutoff_literal(asof: str, window_minutes: int) -> Column:
    """F7 lower bound ``asof - window`` as a TIMESTAMP_NTZ literal."""
    base = datetime.strptime(asof, "%Y-%m-%d %H:%M:%S")
    cut = (base - timedelta(minutes=window_minutes)).strftime("%Y-%m-%d %H:%M:%S")
    return F.lit(cut).cast("timestamp_ntz")


def with_event_ts(facts: DataFrame) -> DataFrame:
    """P9 + parse: ``event_ts`` from the normalised time text (Q25)."""
    if "event_ts" in facts.columns:
        return facts
    return facts.withColumn("event_ts", C.parse_iso_ts(C.normalized_ts_text()))


def in_window(facts: DataFrame, asof: str, window_minutes: int) -> DataFrame:
    """rows whose normalised time is >= asof - window (no upper bound).
    On stored facts (``event_ts`` column, ``event_date`` partitions) the
    bound is a pushed parquet filter plus a partition filter."""
    cut = cutoff_literal(asof, window_minutes)
    rows = with_event_ts(facts)
    if "event_date" in facts.columns:
        rows = rows.where(F.col("event_date") >= F.to_date(cut))
    return rows.where(F.col("event_ts") >= cut)


def _tracked(c: str = "track_id") -> Column:
    return F.col(c).isNotNull() & (F.trim(F.col(c)) != "")


def latest_per_key(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Newest row (``event_ts`` desc, ``id`` desc) per non-blank track within
    ``keys``; rows without a track id are kept as they are (U1).

    One scan, one shuffle: the grouping key is the track id for tracked
    rows and a per-row key (the row id) for the others, so untracked rows
    pass through as singleton groups and never form one hot blank key."""
    other = [k for k in keys if k != "track_id"]
    key = F.when(_tracked(), F.concat(F.lit("t"), F.col("track_id"))) \
        .otherwise(F.concat(F.lit("u"), F.col("id").cast("string")))
    payload = [c for c in cols if c not in other and c != "event_ts"]
    return (rows.withColumn("_key", key).groupBy(*other, "_key")
            .agg(F.max(F.struct("event_ts", *payload)).alias("_m"))
            .select(*other, "_m.*"))


def latest_per_track(facts: DataFrame, asof: str, window_minutes: int,
                     method: str = "aggregate") -> DataFrame:
    """W1 + U1: deduplicated window rows.

    Output: ``id, track_id, line, station, status, failed_testcode, process,
    event_ts``; a table without a track column gives its raw window rows, track
    null. ``method="window"`` is the ROW_NUMBER form (kept for tests and
    for comparing plans)."""
    rows = in_window(facts, asof, window_minutes)
    if "track_id" not in facts.columns:
        return rows.withColumn("track_id", F.lit(None).cast("string")).select(*DEDUP_COLS, "event_ts")
    rows = rows.select(*DEDUP_COLS, "event_ts")
    if method == "window":
        tracked, untracked = rows.where(_tracked()), rows.where(~_tracked())
        w = Window.partitionBy("track_id").orderBy(F.col("event_ts").desc(), F.col("id").desc())
        latest = (tracked.withColumn("_rn", F.row_number().over(w))
                  .where(F.col("_rn") == 1).drop("_rn"))
        return latest.unionByName(untracked.select(*latest.columns))
    return latest_per_key(rows, ["track_id"], DEDUP_COLS)
