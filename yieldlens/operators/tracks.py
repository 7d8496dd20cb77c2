"""Track-level operators.

A *track* is one physical unit. Every operator here is one ``groupBy
(track_id)`` hash aggregate (map-side combined, so a track holding a large
share of the rows is reduced per input partition before the shuffle),
optionally followed by a semi join back to the rows. Null track ids are
excluded (Q12); a blank id is an ordinary track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import columns as C
from .frames import attach


def _tracked(df: DataFrame) -> DataFrame:
    return df.where(F.col("track_id").isNotNull())


def _span_minutes(first: Column, last: Column) -> Column:
    return F.timestamp_diff("SECOND", first, last).cast("double") / 60


def _attribute_columns() -> list[Column]:
    """J5 + W5: first non-null model, line, station of a track in insertion
    (id) order, and the time of its first test, as aggregates."""
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in ("model", "line", "station")]
    return [*first, F.min("event_ts").alias("first_test")]


def classify_by_span(df: DataFrame, max_span: float = K.SPAN_LIMIT_TRACKS, attributes: bool = False) -> DataFrame:
    """A17 (X1): 0 failures Passed; 1 Failed; >= 2 with first-to-last failure
    span <= ``max_span`` minutes NTF; otherwise Real Fail. ``attributes`` adds J5's
    columns from the same aggregate."""
    f = F.col("failed")
    g = (_tracked(df).groupBy("track_id")
         .agg(F.count_if(f).cast("long").alias("failure_count"),
              _span_minutes(F.min(F.when(f, F.col("event_ts"))),
                            F.max(F.when(f, F.col("event_ts")))).alias("failure_span_min"),
              *(_attribute_columns() if attributes else [])))
    status = (F.when(F.col("failure_count") == 0, K.PASSED)
              .when(F.col("failure_count") == 1, K.FAILED)
              .when(F.col("failure_span_min") <= F.lit(float(max_span)), K.NTF)
              .otherwise(K.REAL_FAIL))
    return g.withColumn("overall_status", status)


def classify_by_pattern(df: DataFrame) -> DataFrame:
    """A18 (X2): any Real Fail test -> Real Fail; else any NTF -> NTF; else Passed."""
    g = (_tracked(df).groupBy("track_id")
         .agg(F.bool_or(F.col("status_display") == K.REAL_FAIL).alias("has_real_fail"),
              F.bool_or(F.col("status_display") == K.NTF).alias("has_ntf")))
    return _pattern_status(g)


def classify_by_pattern_within(df: DataFrame, max_span: float = K.SPAN_LIMIT_PATTERN) -> DataFrame:
    """A18 of the tracks that F10 keeps: ``classify_by_pattern(span_filter(df))`` as one aggregate per track."""
    f = F.col("failed")
    g = (_tracked(df).groupBy("track_id")
         .agg(F.bool_or(F.col("status_display") == K.REAL_FAIL).alias("has_real_fail"),
              F.bool_or(F.col("status_display") == K.NTF).alias("has_ntf"), *_span_columns(f)))
    return _pattern_status(g.where(_within(max_span)).drop("_n", "_span"))


def _span_columns(f: Column) -> list[Column]:
    span = _span_minutes(F.min(F.when(f, F.col("event_ts"))), F.max(F.when(f, F.col("event_ts"))))
    return [F.count_if(f).alias("_n"), F.coalesce(span, F.lit(0.0)).alias("_span")]


def _within(max_span: float) -> Column:
    return (F.col("_n") <= 1) | (F.col("_span") <= F.lit(float(max_span)))


def _pattern_status(g: DataFrame) -> DataFrame:
    return g.withColumn("overall_status", F.when(F.col("has_real_fail"), K.REAL_FAIL)
                        .when(F.col("has_ntf"), K.NTF).otherwise(K.PASSED))


def span_filter(df: DataFrame, max_span: float = K.SPAN_LIMIT_PATTERN) -> DataFrame:
    """F10 + J10: keep rows of tracks with <= 1 failed test or a failure
    span <= ``max_span`` minutes (span 0 when there is no failure)."""
    valid = _tracked(df).groupBy("track_id").agg(*_span_columns(F.col("failed"))).where(_within(max_span)).select("track_id")
    return df.join(valid, "track_id", "left_semi")


def status_filter(df: DataFrame, classes: DataFrame, status: str) -> DataFrame:
    """F9 + J10: rows of the tracks whose class is ``status`` ('All' keeps all)."""
    if status == "All":
        return df
    return df.join(classes.where(F.col("overall_status") == status).select("track_id"),
                   "track_id", "left_semi")


def attributes(df: DataFrame) -> DataFrame:
    """J5 + W5 alone: one row per track."""
    return _tracked(df).groupBy("track_id").agg(*_attribute_columns())


def kpis(classes: DataFrame, all_tracks: DataFrame | None = None) -> DataFrame:
    """Tracks per class and % of the classified tracks; ``all_tracks``
    (distinct tracks of the unfiltered frame) is attached when given."""
    from pyspark.sql import Window
    per = classes.groupBy("overall_status").agg(F.count(F.lit(1)).alias("tracks"))
    # at most four class rows: the total is a window over them (no re-read)
    out = per.withColumn("total_tracks", F.sum("tracks").over(Window.partitionBy()).cast("long"))
    if all_tracks is not None:
        out = attach(out, all_tracks.agg(F.count_distinct("track_id").alias("all_tracks")))
    return out.withColumn("pct", C.pct("tracks", "total_tracks", 2))


def class_rate_matrix(tracks: DataFrame, status: str, places: int = 1) -> DataFrame:
    """Share of tracks (classes with attributes) in ``status`` per (first model, first line)."""
    j = tracks.where(F.col("model").isNotNull() & F.col("line").isNotNull())
    return (j.groupBy("model", "line")
            .agg(F.count(F.lit(1)).alias("total_tracks"),
                 F.count_if(F.col("overall_status") == status).cast("long").alias("class_tracks"))
            .withColumn("class_rate", C.pct("class_tracks", "total_tracks", places)))


def classes_by_day(tracks: DataFrame, statuses: tuple[str, ...] = (K.NTF, K.REAL_FAIL)) -> DataFrame:
    """NTF / Real Fail tracks per date of their first test."""
    j = tracks.where(F.col("overall_status").isin(*statuses))
    return (j.groupBy(F.to_date("first_test").alias("date"), "overall_status")
            .agg(F.count(F.lit(1)).alias("tracks")))


def classes_by_station(tracks: DataFrame, statuses: tuple[str, ...] = (K.NTF, K.REAL_FAIL)) -> DataFrame:
    """NTF / Real Fail tracks per first station."""
    j = tracks.where(F.col("overall_status").isin(*statuses) & F.col("station").isNotNull())
    return j.groupBy("station", "overall_status").agg(F.count(F.lit(1)).alias("tracks"))


def span_histogram(classes: DataFrame, bins: int = 30,
                   threshold: float = K.SPAN_LIMIT_TRACKS) -> DataFrame:
    """Equal-width histogram of failure spans of tracks with >= 2
    failures, ``bins`` buckets from min to max (Q15), threshold attached."""
    multi = classes.where(F.col("failure_count") >= 2)
    bounds = multi.agg(F.min("failure_span_min").alias("_mn"), F.max("failure_span_min").alias("_mx"))
    j = attach(multi, bounds)
    width = (F.col("_mx") - F.col("_mn")) / bins
    bucket = F.when(F.col("_mx") == F.col("_mn"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("failure_span_min") - F.col("_mn")) * bins / (F.col("_mx") - F.col("_mn"))) + 1,
                F.lit(bins))).cast("long")
    return (j.withColumn("bucket", bucket)
            .groupBy("bucket", "_mn", "_mx")
            .agg(F.count(F.lit(1)).alias("tracks"))
            .select("bucket", (F.col("_mn") + (F.col("bucket") - 1) * width).alias("bin_start"),
                    (F.col("_mn") + F.col("bucket") * width).alias("bin_end"), "tracks",
                    F.lit(float(threshold)).alias("ntf_threshold")))


def kpis_one_pass(rows: DataFrame, predicate: Column, max_span: float = K.SPAN_LIMIT_TRACKS) -> DataFrame:
    """A19 in one pass over the unfiltered rows: every per-track aggregate is
    conditioned on the filter ``predicate`` (so the classes equal
    ``classify_by_span`` of the filtered rows), and the unfiltered distinct
    track count comes from the same aggregate. Same columns as ``kpis``."""
    from pyspark.sql import Window
    keep = F.coalesce(predicate, F.lit(False))
    f = keep & F.col("failed")
    g = (_tracked(rows).groupBy("track_id")
         .agg(F.bool_or(keep).alias("_in"), F.count_if(f).cast("long").alias("failure_count"),
              _span_minutes(F.min(F.when(f, F.col("event_ts"))),
                            F.max(F.when(f, F.col("event_ts")))).alias("failure_span_min")))
    status = (F.when(~F.col("_in"), F.lit(None))
              .when(F.col("failure_count") == 0, K.PASSED)
              .when(F.col("failure_count") == 1, K.FAILED)
              .when(F.col("failure_span_min") <= F.lit(float(max_span)), K.NTF)
              .otherwise(K.REAL_FAIL))
    per = g.groupBy(status.alias("overall_status")).agg(F.count(F.lit(1)).alias("tracks"))
    everything = Window.partitionBy()     # at most five rows: four classes + "not in filter"
    out = per.select("*", F.sum(F.when(F.col("overall_status").isNotNull(), F.col("tracks")))
                     .over(everything).cast("long").alias("total_tracks"),
                     F.sum("tracks").over(everything).cast("long").alias("all_tracks"))
    return (out.where(F.col("overall_status").isNotNull())
            .withColumn("pct", C.pct("tracks", "total_tracks", 2)))
