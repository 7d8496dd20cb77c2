"""Ingest accounting and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import columns as C


def skip_totals(skips: DataFrame) -> DataFrame:
    """Skip-log rows per reason."""
    return skips.groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


def gap_report(routed: DataFrame, count_no_th4: bool = True,
               count_duplicate: bool = False) -> DataFrame:
    """Files seen = inserted + skipped; one row per skip reason with
    its count and % of seen, plus the totals on every row (inserted facts,
    skipped, seen, gap %, and the late-caught ``rescan_rows``; the NO_TH4 and
    FILE_GONE table totals are their reason rows).

    ``count_no_th4=False`` reproduces the original counters, which never
    counted NO_TH4 files (Q17); DUPLICATE is counted only on request (Q16)."""
    counted = [K.R_PROCESS, K.R_FILE_GONE, K.R_PARSE_ERR]
    if count_no_th4:
        counted.append(K.R_NO_TH4)
    if count_duplicate:
        counted.append(K.R_DUPLICATE)
    o = F.col("outcome")
    late = (o == K.INSERT) & F.col("source").isin(*K.LATE_SOURCES)
    n = {r: F.count_if(o == r).cast("long") for r in counted}
    if K.R_DUPLICATE in n and "copies" in routed.columns:    # first outcomes stand for their later copies
        n[K.R_DUPLICATE] = n[K.R_DUPLICATE] + F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    # one aggregate; the reasons are a fixed list of five
    per = F.array(*(F.struct(F.lit(r).alias("reason"), n.get(r, F.lit(0).cast("long")).alias("count")) for r in K.SKIP_REASONS))
    totals = routed.agg(
        F.count_if(o == K.INSERT).cast("long").alias("inserted"),
        reduce(lambda a, b: a + b, n.values()).alias("skipped"),
        F.count_if(late).cast("long").alias("rescan_rows"), per.alias("_per"))
    totals = totals.withColumn("seen", F.col("inserted") + F.col("skipped")) \
        .withColumn("gap_pct", C.pct("skipped", "seen", 2))
    out = totals.select(F.explode("_per").alias("_r"), "inserted", "skipped", "rescan_rows", "seen", "gap_pct")
    return (out.select("_r.reason", "_r.count", "inserted", "skipped", "rescan_rows", "seen", "gap_pct")
            .withColumn("pct", C.pct("count", "seen", 2)))


def hour_label(ts_text) -> F.Column:
    """'yyyy-MM-dd HH:00' of an ISO time text (``T`` or space); null when
    the text does not parse."""
    return F.date_format(C.parse_iso_ts(ts_text), "yyyy-MM-dd HH:00")


def _hour_of(df: DataFrame) -> F.Column:
    # a typed parse time, when the frame carries one, avoids re-parsing text
    if "event_ts" in df.columns:
        return F.date_format("event_ts", "yyyy-MM-dd HH:00")
    return hour_label(F.col("timestamp"))


def hourly_gap(facts: DataFrame, skips: DataFrame) -> DataFrame:
    """A29 + J9: per hour inserted rows and skip-log rows per reason, total
    and gap % (2 places); rows without a parsable time are left out."""
    # null hours stay a group until after the full outer join: a filter
    # there cannot be pushed into either side, so the parse expressions
    # below are not inlined into a pushed-down predicate
    ins = facts.groupBy(_hour_of(facts).alias("hour")).agg(F.count(F.lit(1)).alias("inserted"))
    sk = (skips.select(_hour_of(skips).alias("hour"), "reason")
          .groupBy("hour").pivot("reason", K.HOURLY_GAP_REASONS).agg(F.count(F.lit(1))))
    j = ins.join(sk, "hour", "full_outer").where(F.col("hour").isNotNull())
    cnt = {r: F.coalesce(F.col(r), F.lit(0)).cast("long") for r in K.HOURLY_GAP_REASONS}
    out = j.select("hour", F.coalesce("inserted", F.lit(0)).cast("long").alias("inserted"),
                   *[cnt[r].alias(r) for r in K.HOURLY_GAP_REASONS])
    total = F.col("inserted")
    for r in K.HOURLY_GAP_REASONS:
        total = total + F.col(r)
    out = out.withColumn("total", total)
    return out.withColumn("gap_pct", C.pct(F.col("total") - F.col("inserted"), "total", 2))


def hourly_gap_routed(routed: DataFrame) -> DataFrame:
    """A29 in one pass over routed rows (inserted records and skip-log rows
    carry the same record time): one conditional aggregate per hour, no
    join. Equal to ``hourly_gap(records(routed), skip_log(routed))``."""
    o = F.col("outcome")
    rows = routed.where(o.isin(K.INSERT, *K.HOURLY_GAP_REASONS))
    out = (rows.groupBy(_hour_of(rows).alias("hour"))
           .agg(F.count_if(o == K.INSERT).cast("long").alias("inserted"),
                *[F.count_if(o == r).cast("long").alias(r) for r in K.HOURLY_GAP_REASONS])
           .where(F.col("hour").isNotNull()))
    total = F.col("inserted")
    for r in K.HOURLY_GAP_REASONS:
        total = total + F.col(r)
    out = out.withColumn("total", total)
    return out.withColumn("gap_pct", C.pct(F.col("total") - F.col("inserted"), "total", 2))


def write_hourly_csv(report: DataFrame, path: str) -> None:
    """The hourly report as CSV ordered by hour: a range-partitioned
    sort, so the part files read in name order are in hour order and no
    single task has to write the whole report."""
    (report.orderBy("hour").write.mode("overwrite")
     .option("header", True).csv(path))


def clean_csv(csv: DataFrame) -> DataFrame:
    """Strip every column, missing -> ''."""
    return csv.select(*[F.coalesce(C.strip_ws(F.col(c)), F.lit("")).alias(c) for c in csv.columns])


def read_reconciliation_csv(spark, path: str, line_ends: bool = True) -> DataFrame:
    """S7 source: the six external columns by header name, in any order among others;
    a missing column reads ''. Quoted fields may hold quotes ("" for one) and line ends; a file is split over
    tasks only where the caller says that none holds ``line_ends``."""
    raw = spark.read.csv(path, header=True, multiLine=line_ends, quote='"', escape='"')
    return clean_csv(raw.select(*[F.col(f"`{f.name}`") if f.name in raw.columns else F.lit("").alias(f.name)
                                  for f in K.RECONCILIATION_CSV.fields]))


def reconcile(csv: DataFrame, facts: DataFrame, few: bool = False, by_date: bool = False) -> DataFrame:
    """Every external row looks up (track, process, date) in the facts;
    at most one match (the first inserted); found flag, matched time, note.

    The facts are read once and reduced to one row per key with ``min_by`` (map-side combined, so a hot key moves
    as one row a partition), then left-joined: no fan-out. ``few``: the caller knows that the external rows are few
    (a day's file); then the facts are semi-joined to the keys before they are reduced, and those of other keys do not
    move at all. ``by_date``: stored facts whose ``date`` is that of their time, as the ingest job writes them; they are
    pruned to the span of the external dates, whole folders at a time."""
    ext = clean_csv(csv).select(*[F.col(c).alias(f"_x_{c.lower()}") for c in csv.columns])
    k = ["track_id", "process", "date"]
    if by_date:
        dates = ext.agg(F.struct(F.min(F.to_date(F.col("_x_date").try_cast("date"))).alias("first"),
                                 F.max(F.to_date(F.col("_x_date").try_cast("date"))).alias("last")).alias("d"))
        facts = facts.where(F.col("event_date").isNull()     # no time, so any date
                            | F.col("event_date").between(dates.select("d.first").scalar(), dates.select("d.last").scalar()))
    if few:
        facts = facts.join(ext.select(*[F.col(f"_x_{c}").alias(c) for c in k]).distinct(), k, "left_semi")
    hits = facts.groupBy(*k).agg(F.min_by("timestamp", "id").alias("db_timestamp"), F.lit(1).alias("_hit"))
    j = ext.join(hits, (ext["_x_track_id"] == hits["track_id"]) & (ext["_x_process"] == hits["process"])
                 & (ext["_x_date"] == hits["date"]), "left")
    mqs_ts = F.when((F.col("_x_date") != "") & (F.col("_x_time") != ""),
                    F.concat(F.col("_x_date"), F.lit(" "), F.col("_x_time")))
    return j.select(F.col("_x_track_id").alias("track_id"), F.col("_x_process").alias("process"),
                    F.col("_x_station").alias("station"), mqs_ts.alias("mqs_timestamp"),
                    F.col("_x_reason").alias("mqs_status"),
                    F.coalesce("_hit", F.lit(0)).cast("int").alias("found_in_db"),
                    "db_timestamp", F.lit("auto-reconciled").alias("note"))


def reconcile_totals(result: DataFrame) -> DataFrame:
    """J1 totals: rows, matched, missing."""
    return result.agg(F.count(F.lit(1)).alias("inserted"),
                      F.count_if(F.col("found_in_db") == 1).cast("long").alias("matched")) \
        .withColumn("missing", F.col("inserted") - F.col("matched"))

