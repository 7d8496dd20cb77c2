"""Dashboard tables.

Inputs are prepared (and usually filtered) frames from ``prepare``. Every
table is one aggregate with conditional counts (``count_if``) instead of the
"total join failures" pairs of the reproduced system. Grouping keys that are
null are dropped first (pandas ``groupby`` semantics, Q11). Top-k tables use
``orderBy().limit()`` (TakeOrderedAndProject) with a name tie-break (Q5);
global windows run only after such a top-k, on at most k rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import columns as C
from .frames import attach, single_row


def _nonnull(df: DataFrame, *keys: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def _cnt(cond: Column, name: str) -> Column:
    return F.count_if(cond).cast("long").alias(name)


def _with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    return attach(df, scalar)


# --- A1 / A2 / A3 ---------------------------------------------------------

def status_counts(df: DataFrame, dim: str) -> DataFrame:
    """A1: rows per (dimension value, status label)."""
    return (_nonnull(df, dim).groupBy(dim, F.col("status_display").alias("status"))
            .agg(F.count(F.lit(1)).alias("count")))


def test_kpis(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """A2 + A3: one row of test KPIs over the rows where ``predicate`` holds
    (all rows when None); ``total_all`` / ``delta`` compare with every row
    of ``df``. The rows are reduced to one per track with its counts and flags, and apart from that to
    the few (station, line) pairs, so that no row is copied for each distinct count."""
    keep = F.coalesce(F.lit(True) if predicate is None else predicate, F.lit(False))
    coded = F.col("failed_testcode") != ""
    f = keep & F.col("failed")
    tracks = df.groupBy("track_id").agg(
        _cnt(keep, "total"), _cnt(keep & (F.col("status") == "P"), "passed"), _cnt(f, "failed"),
        F.count(F.lit(1)).alias("total_all"), F.bool_or(keep).alias("_in"),
        F.bool_or(f & coded).alias("_coded"), F.bool_or(f & ~coded).alias("_uncoded"))
    named = F.col("track_id").isNotNull()
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total", "passed", "failed", "total_all")]
    per_track = tracks.agg(*sums, _cnt(named & F.col("_in"), "unique_tracks"),
                           _cnt(named & F.col("_coded"), "failed_tracks_with_code"),
                           _cnt(named & F.col("_uncoded"), "failed_tracks_without_code"))
    pairs = df.where(keep).groupBy("station", "line").agg(F.lit(1).alias("_one"))
    places = [pairs.groupBy(c).agg(F.lit(1).alias("_one")).agg(F.count(c).alias(name))
              for c, name in (("station", "unique_stations"), ("line", "unique_lines"))]
    kpi = single_row(per_track, *places).select(
        "total", "passed", "failed", "unique_tracks", "unique_stations", "unique_lines", "failed_tracks_with_code",
        "failed_tracks_without_code", "total_all")
    return kpi.select("*", C.pct("passed", "total", 2).alias("pass_pct"),
                      C.pct("failed", "total", 2).alias("fail_pct"),
                      (F.col("total") - F.col("total_all")).alias("delta"))


# --- A4 / A5 / A7 / A22 / R1 / R2 ------------------------------------------

def fail_matrix(df: DataFrame, row: str, col: str, cond: Column | None = None,
                places: int = 1, columns: list[str] | None = None) -> DataFrame:
    """Total, matching rows and % per (row, col) cell. ``cond``
    defaults to failed rows. ``columns`` names the ``col`` values that get a
    column each, with gaps 0 (R1)."""
    cond = F.col("failed") if cond is None else cond
    long_ = (_nonnull(df, row, col).groupBy(row, col)
             .agg(F.count(F.lit(1)).alias("total"), _cnt(cond, "fails"))
             .withColumn("fail_pct", C.pct("fails", "total", places)))
    if columns is None:
        return long_
    return long_.groupBy(row).pivot(col, columns).agg(F.first("fail_pct")).fillna(0)


def league(df: DataFrame, k: int = 15) -> DataFrame:
    """Model-process pairs by failure rate (1 place), top ``k``."""
    g = (_nonnull(df, "model", "process").groupBy("model", "process")
         .agg(F.count(F.lit(1)).alias("total"), _cnt(F.col("failed"), "fails")))
    g = g.select("model", "process", "total", (F.col("total") - F.col("fails")).alias("passed"),
                 "fails", C.pct("fails", "total", 1).alias("fail_rate"))
    return g.orderBy(F.col("fail_rate").desc(), "model", "process").limit(k)


def distinct_failed_tracks(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct failed tracks per model x process; ``columns`` names the
    processes that get a column each, with gaps 0."""
    long_ = (_nonnull(df.where(F.col("failed")), "model", "process").groupBy("model", "process")
             .agg(F.count_distinct("track_id").alias("failed_tracks")))
    if columns is None:
        return long_
    return long_.groupBy("model").pivot("process", columns).agg(F.first("failed_tracks")).fillna(0)


# --- A8 / A9 / W2 ---------------------------------------------------------

def _code_counts(df: DataFrame, blank_code: bool) -> DataFrame:
    fails = df.where(F.col("failed"))
    if not blank_code:
        fails = fails.where(F.col("failed_testcode") != "")
    return (fails.groupBy(F.col("failed_testcode").alias("code"))
            .agg(F.count(F.lit(1)).alias("count"),
                 F.min_by("track_id", "id").alias("example_track")))


def _running_pct(top: DataFrame, places: int | None) -> DataFrame:
    # Global window, but only over the <= k rows kept by the top-k
    order = Window.orderBy(F.col("count").desc(), F.col("code").asc())
    cum = F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0))
    allw = F.sum("count").over(Window.partitionBy())
    raw = cum.cast("double") / allw * 100
    return top.select("*", F.row_number().over(order).cast("long").alias("rank"),
                      (raw if places is None else F.bround(raw, places)).alias("cum_pct"))


def pareto(df: DataFrame, k: int = 20, blank_code: bool = False,
           places: int | None = 1) -> DataFrame:
    """A8 + W2: failure codes by count, top ``k``, cumulative % of the
    kept rows (ends at 100, Q10). ``blank_code=False`` drops '' codes."""
    top = _code_counts(df, blank_code).orderBy(F.col("count").desc(), "code").limit(k)
    return _running_pct(top.select("code", "count"), places)


def code_detail(df: DataFrame, k: int = 20, blank_code: bool = False) -> DataFrame:
    """Top codes with % of all (kept) coded failures, cumulative % and
    an example track (the first failed row with that code by insertion)."""
    # codes are free text, so their total is an aggregate of its own over the
    # pruned rows, not a window that brings every code to one task
    counts = _code_counts(df, blank_code)
    counts = attach(counts, counts.agg(F.sum("count").alias("_all")))
    top = counts.orderBy(F.col("count").desc(), "code").limit(k)
    out = _running_pct(top, 1)
    return out.select("code", "count", C.pct("count", "_all", 1).alias("pct_of_failures"),
                      "cum_pct", "example_track", "rank")


def failures_by_process(df: DataFrame) -> DataFrame:
    """A10."""
    return (_nonnull(df.where(F.col("failed")), "process").groupBy("process")
            .agg(F.count(F.lit(1)).alias("count")))


def hierarchy(df: DataFrame) -> DataFrame:
    """Process -> station -> code roll-up of failed rows; every parent
    is the sum of its leaves; the third level falls back to the status label
    when no failed row carries a code.

    The rows are reduced to (process, station, code, status) counts, which are
    rolled up; the "any code" flag is a one-row aggregate of its own, so no
    task meets all leaves."""
    fails = _nonnull(df.where(F.col("failed")), "process", "station")
    leaves = (fails.groupBy("process", "station", "failed_testcode", "status_display")
              .agg(F.count(F.lit(1)).alias("_n")))
    leaves = attach(leaves, fails.agg(F.max(F.col("failed_testcode") != "").alias("_any")))
    leaf = F.when(F.coalesce(F.col("_any"), F.lit(False)), F.col("failed_testcode")) \
        .otherwise(F.col("status_display"))
    return (leaves.withColumn("leaf", leaf)
            .rollup("process", "station", "leaf")
            .agg(F.sum("_n").cast("long").alias("count"), F.grouping_id().cast("long").alias("level")))


def failure_types(df: DataFrame) -> DataFrame:
    """Failed tests split into NTF / Real Fail (Q2: intended spelling)."""
    return (df.where(F.col("failed")).groupBy(F.col("status_display").alias("status"))
            .agg(F.count(F.lit(1)).alias("count")))


def top_codes_per_model(df: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent failure codes of every model."""
    g = (_nonnull(df.where(F.col("failed")), "model", "failed_testcode")
         .groupBy("model", "failed_testcode").agg(F.count(F.lit(1)).alias("count")))
    w = Window.partitionBy("model").orderBy(F.col("count").desc(), "failed_testcode")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


# --- A12 / A13 / A14 / J8 ---------------------------------------------------

def hourly(df: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Rows per (hour, status). With ``statuses`` given the result is
    the dense 24 x statuses grid, missing cells 0 (J8, Q14)."""
    counts = df.groupBy("hour", F.col("status_display").alias("status")) \
        .agg(F.count(F.lit(1)).alias("count"))
    if statuses is None:
        return counts
    spark = df.sparkSession
    grid = spark.range(24).select(
        F.col("id").alias("hour"),
        F.explode(F.array(*[F.lit(s) for s in statuses])).alias("status"))
    return (grid.join(counts, ["hour", "status"], "left")
            .select("hour", "status", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def daily(df: DataFrame) -> DataFrame:
    """A13 (several dates): rows per (date, status)."""
    return df.groupBy("date", F.col("status_display").alias("status")).agg(F.count(F.lit(1)).alias("count"))


def by_minute(df: DataFrame) -> DataFrame:
    """A13 (one date): rows per (minute, status)."""
    # date_trunc returns a zoned timestamp; the facts are zone-less
    return (df.groupBy(F.date_trunc("MINUTE", "event_ts").cast("timestamp_ntz").alias("minute"),
                       F.col("status_display").alias("status"))
            .agg(F.count(F.lit(1)).alias("count")))


def fail_rate_by_hour(df: DataFrame) -> DataFrame:
    """Per hour total, failures and rate (2 places)."""
    return (df.groupBy("hour").agg(F.count(F.lit(1)).alias("total"), _cnt(F.col("failed"), "fails"))
            .withColumn("fail_rate", C.pct("fails", "total", 2)))


# --- A15 / A16 / R3 ---------------------------------------------------------

def station_stats(df: DataFrame, profile: str = "tests") -> DataFrame:
    """Per station totals and rates. ``tests``: failed = total - passed
    (unknown statuses count as failed, Q8); ``span``: failed = status F;
    ``pattern``: NTF / Real Fail split."""
    g = _nonnull(df, "station").groupBy("station")
    if profile == "pattern":
        return (g.agg(F.count(F.lit(1)).alias("total"),
                      _cnt(F.col("status_display") == K.REAL_FAIL, "real_fails"),
                      _cnt(F.col("status_display") == K.NTF, "ntf"),
                      _cnt(F.col("status_display") == K.PASSED, "passed"))
                .withColumn("real_fail_rate", C.pct("real_fails", "total", 1))
                .withColumn("ntf_rate", C.pct("ntf", "total", 1)))
    passed = F.col("status") == "P" if profile == "tests" else ~F.col("failed")
    return (g.agg(F.count(F.lit(1)).alias("total"), _cnt(passed, "passed"))
            .withColumn("failed", F.col("total") - F.col("passed"))
            .withColumn("fail_rate", C.pct("failed", "total", 1)))


def station_top_long(df: DataFrame, statuses: list[str], label: Column | None = None,
                     k: int = 15) -> DataFrame:
    """A16 + R3: station x status counts with guaranteed columns, total,
    top ``k`` stations by total, returned in long form (station, status, count)."""
    label = F.col("status_display") if label is None else label
    wide = (_nonnull(df, "station").groupBy("station")
            .agg(*[_cnt(label == s, s) for s in statuses]))
    total = reduce(lambda a, b: a + b, [F.col(f"`{s}`") for s in statuses])
    top = wide.withColumn("total", total).orderBy(F.col("total").desc(), "station").limit(k)
    return top.unpivot(["station", "total"], statuses, "status", "count")


def tests_label() -> Column:
    """Label used by the test-level station chart: Passed, else Failed."""
    return F.when(F.col("status") == "P", K.PASSED).otherwise(K.FAILED)


def export_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen columns, time formatted, newest first."""
    cols = [F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp")
            if c == "timestamp" else F.col(c) for c in columns]
    return df.orderBy(F.col("event_ts").desc(), F.col("id").desc()).select(*cols)


def export(df: DataFrame, columns: list[str], path: str) -> None:
    """S9 sink: CSV with header."""
    export_frame(df, columns).write.mode("overwrite").option("header", True).csv(path)
