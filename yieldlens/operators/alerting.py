"""Alert evaluation over the trailing window.

Inputs are the fact table and an explicit ``asof``; the deduplicated window
(W1) is computed once by the caller and shared by every function here; it may
also come pre-counted, each row standing for ``units`` equal ones.
All per-line work is done for all lines in one pass (the system we reproduce
re-ran the dedup once per line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import columns as C
from .dedup import cutoff_literal, with_event_ts
from .frames import attach, single_row


def _line_counts(latest: DataFrame) -> DataFrame:
    n = _weight(latest)
    return (latest.groupBy("line")
            .agg(F.sum(n).alias("total"),
                 F.sum(F.when(C.alert_failed(), n).otherwise(0)).alias("failed")))


def _weight(latest: DataFrame) -> Column:
    """Units that a row stands for: ``units`` of pre-counted rows, else one."""
    return (F.col("units") if "units" in latest.columns else F.lit(1)).cast("long")


def line_rates(latest: DataFrame, min_samples: int = K.MIN_SAMPLES,
               threshold: float = K.FAILURE_THRESHOLD, k: int = K.TOP_N_LINES) -> DataFrame:
    """Lines with total >= min_samples and rate > threshold (strict),
    highest rate first (line name breaks ties), top ``k``."""
    raw = F.col("failed") * 100.0 / F.col("total")
    return (_line_counts(latest)
            .where((F.col("total") >= min_samples) & (raw > threshold))
            .withColumn("_raw", raw)
            .orderBy(F.col("_raw").desc(), F.col("line").asc_nulls_last())
            .limit(k)
            .select("line", "total", "failed", F.bround("_raw", 2).alias("rate")))


def line_status(latest: DataFrame, min_samples: int = K.MIN_SAMPLES,
                threshold: float = K.FAILURE_THRESHOLD, k: int | None = None,
                alerts: DataFrame | None = None) -> DataFrame:
    """Every line with total >= min_samples, its rate and an
    ``above`` flag (rounded rate > threshold, as displayed); ``k=10`` is the
    diagnostic variant. With ``alerts`` the open / resolved alert counts are
    attached to every row."""
    raw = F.col("failed") * 100.0 / F.col("total")
    out = (_line_counts(latest).where(F.col("total") >= min_samples)
           .withColumn("_raw", raw)
           .withColumn("rate", F.bround("_raw", 2))
           .withColumn("above", F.col("rate") > F.lit(threshold))
           .orderBy(F.col("_raw").desc(), F.col("line").asc_nulls_last()))
    if k is not None:
        out = out.limit(k)
    out = out.select("line", "total", "failed", "rate", "above")
    if alerts is not None:
        out = attach(out, alert_counts(alerts))
    return out


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Open and resolved alert counts (one row)."""
    return alerts.agg(F.count_if(F.col("resolved") == 0).cast("long").alias("open_alerts"),
                      F.count_if(F.col("resolved") == 1).cast("long").alias("resolved_alerts"))


def top_codes(latest: DataFrame, k: int = K.TOP_N_TESTCODES) -> DataFrame:
    """A33 + P11 + W4: per line, the ``k`` (primary code, process) pairs with
    most failed units; rate against all units of the line (1 place).

    One aggregate over the rows: qualifying failed rows group by (line, code,
    process), every other row by its line alone; the line total is a window
    over that small result."""
    q = (C.alert_failed() & F.col("failed_testcode").isNotNull()
         & (F.trim(F.col("failed_testcode")) != ""))
    g = (latest.groupBy("line", q.alias("_q"), F.when(q, C.primary_code()).alias("code"),
                        F.when(q, F.col("process")).alias("process"))
         .agg(F.sum(_weight(latest)).alias("_n")))
    g = g.withColumn("total_line", F.sum("_n").over(Window.partitionBy("line")).cast("long"))
    w = Window.partitionBy("line").orderBy(F.col("_n").desc(), F.col("code").asc_nulls_last(),
                                           F.col("process").asc_nulls_last())
    ranked = (g.where("_q").withColumn("rank", F.row_number().over(w).cast("long"))
              .where(F.col("rank") <= k))
    return ranked.select(
        "line", "rank",
        F.coalesce(F.when(F.col("code") != "", F.col("code")), F.lit("UNKNOWN")).alias("testcode"),
        F.coalesce(F.col("process"), F.lit("N/A")).alias("process"),
        F.col("_n").alias("failed_units"), "total_line",
        C.pct("_n", "total_line", 1).alias("rate"))


def worst_station(latest: DataFrame) -> DataFrame:
    """Per line the station with most failed units (name breaks ties);
    the line name itself when the line has no failures. One aggregate over
    (line, station), then a per-line window over that small result."""
    units = F.when(C.alert_failed(), _weight(latest)).otherwise(0)
    g = latest.groupBy("line", "station").agg(F.sum(units).alias("failed"))
    w = Window.partitionBy("line").orderBy(F.col("failed").desc(), F.col("station").asc_nulls_last())
    best = g.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return best.select("line",
                       F.when(F.col("failed") > 0, F.col("station")).otherwise(F.col("line")).alias("station"),
                       "failed")


def diagnostics(facts: DataFrame, latest: DataFrame, asof: str, window_minutes: int,
                alerts: DataFrame | None = None) -> DataFrame:
    """Raw and deduplicated window counts in one row, plus the number
    of rows whose time text does not parse (excluded, Q25), all rows and,
    with ``alerts``, the open alert count."""
    rows = with_event_ts(facts)
    cut = cutoff_literal(asof, window_minutes)
    inwin = F.col("event_ts") >= cut
    raw = rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("event_ts").isNull()).cast("long").alias("unparsable_rows"),
        F.count_if(inwin).cast("long").alias("raw_rows"),
        F.count_if(inwin & C.alert_failed()).cast("long").alias("raw_failures"),
        F.min(F.when(inwin, F.col("event_ts"))).alias("earliest"),
        F.max(F.when(inwin, F.col("event_ts"))).alias("latest"))
    dd = latest.agg(F.count(F.lit(1)).alias("dedup_rows"),
                    F.count_if(C.alert_failed()).cast("long").alias("dedup_failures"))
    parts = [raw, dd]
    if alerts is not None:
        parts.append(alert_counts(alerts).select("open_alerts"))
    return single_row(*parts)


def latest_rows(facts: DataFrame, asof: str, window_minutes: int, k: int = 5) -> DataFrame:
    """Newest ``k`` rows of the whole table with an in-window flag."""
    rows = with_event_ts(facts).where(F.col("event_ts").isNotNull())
    return (rows.orderBy(F.col("event_ts").desc(), F.col("id").desc()).limit(k)
            .select("id", "line", "station", "status", "event_ts",
                    (F.col("event_ts") >= cutoff_literal(asof, window_minutes)).alias("in_window")))
