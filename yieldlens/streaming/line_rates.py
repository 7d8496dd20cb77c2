"""ST7-ST9: sliding-window line failure rates and alerts over a stream of facts.

The reproduced system re-evaluates "last 240 minutes" every 1800 s with no
watermark. As a stream: event time -> watermark -> newest row per (pane of one
slide, track) -> sliding window (240 min, slide 30 min) -> newest row per
(window, track) -> counts per window, all in append mode. Rows are reduced to
panes before they are copied into the windows that overlap them.
Alerts are raised per micro-batch in ``foreachBatch`` against the alert state
(J7). Their windows carry codes and stations, and a backlog of those as state outgrows the
executors' heap: each batch evaluates the windows it closes with shuffles that spill, and the
panes that later windows need are a folder of the checkpoint.
The batch form (``operators.alerting`` with an explicit ``asof``) gives
the same numbers for any window the watermark has closed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

from .. import schemas as K
from ..functions import columns as C
from ..operators import alerting as A
from ..operators import lifecycle as L
from ..operators.dedup import with_event_ts
from ..sources.store import Store, Table, changed
from .state import state_store

TRACK_COLS = ["id", "line", "station", "status", "failed_testcode", "process"]
RATE_COLS = TRACK_COLS[:4]       # what follows the status chooses between rows of the same line and status only
WINDOW_ROWS = ["line", "station", "process", "status", "failed_testcode"]
#: The end of a pane, the key of a track, and its newest row in the pane.
PANES = StructType([StructField("pane_end", TimestampNTZType()), StructField("_key", StringType()),
                    StructField("_m", StructType([StructField("event_ts", TimestampNTZType()), *[K.LOG_DATA[c] for c in TRACK_COLS]]))])


def _track_key() -> Column:
    """The track; untracked rows keep their own key (the row id) so no blank key gets hot."""
    tracked = F.col("track_id").isNotNull() & (F.trim(F.col("track_id")) != "")
    return F.when(tracked, F.col("track_id")).otherwise(F.concat(F.lit("\u0000"), F.col("id").cast("string")))


def _latest_per_window(facts_stream: DataFrame, window: str, slide: str, watermark: str, cols: list[str]) -> DataFrame:
    """w and the newest row of every (window, track); untracked rows each."""
    rows = with_event_ts(facts_stream).where(F.col("event_ts").isNotNull())
    # watermarks need TIMESTAMP (session zone); the facts are zone-less (Q24)
    rows = rows.withColumn("_et", F.col("event_ts").cast("timestamp")).withWatermark("_et", watermark)
    panes = (rows.withColumn("_key", _track_key()).groupBy(F.window("_et", slide).alias("pane"), "_key")
             .agg(F.max(F.struct("_et", *cols)).alias("_m")))
    return (panes.groupBy(F.window("pane", window, slide).alias("w"), "_key")
            .agg(F.max("_m").alias("_m")).select("w", "_m.*"))


def _bounds() -> list:
    return [F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end")]


def stream_line_rates(facts_stream: DataFrame, window: str = "240 minutes", slide: str = "30 minutes",
                      watermark: str = "240 minutes") -> DataFrame:
    """Streaming DF of (window_start, window_end, line, total, failed)."""
    return _per_line(_latest_per_window(facts_stream, window, slide, watermark, RATE_COLS))


def _per_line(latest: DataFrame) -> DataFrame:
    per_line = latest.groupBy("w", "line").agg(F.count(F.lit(1)).alias("total"),
                                               F.count_if(C.alert_failed()).cast("long").alias("failed"))
    return per_line.select(*_bounds(), "line", "total", "failed")


def pane_rows(facts: DataFrame, slide: str) -> DataFrame:
    """Rows as ``PANES``, not reduced yet."""
    rows = with_event_ts(facts).where(F.col("event_ts").isNotNull())
    return rows.select(F.window("event_ts", slide)["end"].alias("pane_end"), _track_key().alias("_key"),
                       F.struct("event_ts", *TRACK_COLS).alias("_m"))


def newest_per_pane(panes: DataFrame) -> DataFrame:
    return panes.groupBy("pane_end", "_key").agg(F.max("_m").alias("_m"))


def standing_rows(panes: DataFrame) -> DataFrame:
    """The newest row of every (pane, track), and the end of the track's next pane: a window that holds that
    one too has a newer row of the track. So no row is copied into its windows before it is compared."""
    newest = newest_per_pane(panes).select("pane_end", "_key", *[f"_m.{c}" for c in WINDOW_ROWS])
    later = F.lead("pane_end").over(Window.partitionBy("_key").orderBy("pane_end"))
    return newest.select("pane_end", later.alias("next_end"), *WINDOW_ROWS)


def window_units(standing: DataFrame, after: Column | None, until: Column, window: str, slide: str) -> DataFrame:
    """The deduplicated rows of each window that ends later than ``after`` and not later than ``until``: window_start,
    window_end, line, station, process, status, failed_testcode, units (1). What rates, top codes and worst
    stations of an alert are computed from."""
    span, step = F.expr(f"INTERVAL {window}"), F.expr(f"INTERVAL {slide}")
    # not F.window: where one plan has its rows twice, what is held of them is not known again
    ends = F.sequence(F.col("pane_end") - step + span, F.col("pane_end"), -step)
    rows = standing.withColumn("window_end", F.explode(ends))
    rows = rows.where((F.col("window_end") <= until) & (F.col("next_end").isNull() | (F.col("next_end") > F.col("window_end"))))
    return ((rows if after is None else rows.where(F.col("window_end") > after))
            .select((F.col("window_end") - span).alias("window_start"), "window_end", *WINDOW_ROWS, F.lit(1).cast("long").alias("units")))


def closed_windows(facts: DataFrame, batch_id: int, folder: str, each: Callable[[DataFrame], None], window: str = "240 minutes",
                   slide: str = "30 minutes", watermark: str = "240 minutes") -> None:
    """``each`` on the ``window_units`` of the windows that a batch closes: those that end no later than the newest row
    less the watermark. Rows whose panes were closed by earlier batches are dropped. The panes that open
    windows need, the newest row's always among them, are kept in ``folder`` batch by batch; a replayed batch
    takes those of the batch before it again."""
    spark = facts.sparkSession
    newest = lambda panes: panes.agg(F.max("_m.event_ts")).first()[0]
    mark = lambda t: F.lit(str(t)).cast("timestamp_ntz") - F.expr(f"INTERVAL {watermark}")
    rows, seen = pane_rows(facts, slide), None
    if batch_id:
        kept = spark.read.schema(PANES).parquet(f"{folder}/batch={batch_id - 1}")
        seen = newest(kept)
        rows = (rows if seen is None else rows.where(F.col("pane_end") > mark(seen))).unionByName(kept)
    latest = newest(rows)
    last_end = F.col("pane_end") - F.expr(f"INTERVAL {slide}") + F.expr(f"INTERVAL {window}")
    still_open = rows if latest is None else rows.where(last_end > mark(latest))
    newest_per_pane(still_open).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
    if latest != seen:
        standing = standing_rows(rows).persist(StorageLevel.DISK_ONLY)
        try:
            each(window_units(standing, None if seen is None else mark(seen), mark(latest), window, slide))
        finally:
            standing.unpersist()
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={batch_id - 2}")
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def start_line_rates(facts_stream: DataFrame, sink_path: str, checkpoint: str,
                     trigger: dict | None = None, **kw):
    """Append the closed windows to a parquet table."""
    q = (stream_line_rates(facts_stream, **kw).writeStream.outputMode("append").format("parquet")
         .option("path", sink_path).option("checkpointLocation", checkpoint))
    return q.trigger(**(trigger or {"processingTime": "30 minutes"})).start()


def alert_table(spark: SparkSession, state_root: str, name: str) -> DataFrame:
    """The current rows of an alert or repair table (``streaming.state``)."""
    return state_store(spark, state_root).newest(name)


def window_counts(units: DataFrame) -> DataFrame:
    """Per window and line: asof (the window's end), line, total, failed."""
    n, failed = F.col("units"), F.when(C.alert_failed(), F.col("units")).otherwise(0)
    return units.groupBy(F.col("window_end").alias("asof"), "line").agg(F.sum(n).alias("total"), F.sum(failed).alias("failed"))


def first_breaches(counts: DataFrame, min_samples: int, threshold: float, k: int) -> DataFrame:
    """Per line the oldest window in which it is among the ``k`` lines above the
    threshold (A31 per window): asof (the window's end), line, total, failed, rate."""
    raw = F.col("failed") * 100.0 / F.col("total")
    per = counts.where((F.col("total") >= min_samples) & (raw > threshold))
    order = Window.partitionBy("asof").orderBy(raw.desc(), F.col("line").asc_nulls_last())
    top = per.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
    first = top.groupBy("line").agg(F.min(F.struct("asof", "total", "failed")).alias("_f")).select("line", "_f.*")
    return first.select("asof", "line", "total", "failed", F.bround(raw, 2).alias("rate"))


def alert_batch(units: DataFrame, batch_id: int, state_root: str, min_samples: int = K.MIN_SAMPLES,
                threshold: float = K.FAILURE_THRESHOLD, k: int = K.TOP_N_LINES, run: str = "batch") -> None:
    """ST8 (``foreachBatch`` body) over the windows that the batch closed (``window_units``; read twice).
    Evaluating them one by one, oldest first, opens an alert for a line in its first window above
    the threshold, unless it has an open alert (J7), with the codes and worst station of that
    window; all lines are done at once, as no alert is closed here. An alert that was resolved since
    (``streaming.state``) lets its line alert again. Breaching lines with an open
    alert but without a repair row get one (L1, L2). New and changed rows are one commit, and a
    replayed batch is left out."""
    spark = units.sparkSession
    store = state_store(spark, state_root)
    if store.has(run, batch_id):
        return
    held = [window_counts(units).persist()]
    try:
        # the time of the last window stands for the evaluation that mends missing rows
        last = held[0].agg(F.date_format(F.max("asof"), "yyyy-MM-dd HH:mm:ss")).first()[0]
        if last is None:
            return
        alerts, repairs = store.newest("failure_alerts"), store.newest("repair_actions")
        rates = first_breaches(held[0], min_samples, threshold, k).persist()
        held.append(rates)
        rates.count()                                        # its size is known where the rows of all windows meet it
        here = units.join(rates.select("line", F.col("asof").alias("window_end")), ["line", "window_end"], "left_semi").persist()
        held.append(here)
        mended = L.ensure_repairs(rates, alerts, repairs, last)
        new_alerts, new_repairs = L.open_alerts(rates, A.top_codes(here), A.worst_station(here), alerts, mended, None)
        store.commit({"failure_alerts": new_alerts,
                      "repair_actions": new_repairs.unionByName(changed(mended, repairs, "id"))}, run, batch_id)
    finally:
        for df in held:
            df.unpersist()


def start_alerts(facts_stream: DataFrame, state_root: str, checkpoint: str, trigger: dict | None = None,
                 min_samples: int = K.MIN_SAMPLES, threshold: float = K.FAILURE_THRESHOLD,
                 k: int = K.TOP_N_LINES, **kw):
    """ST7 + ST8 as one running job: windows -> alerts and repair rows under ``state_root``.
    Batches are numbered per checkpoint, so the rows name the checkpoint as their run."""
    run = f"{zlib.crc32(checkpoint.encode()):08x}"

    def batch(df: DataFrame, bid: int) -> None:
        closed_windows(df, bid, f"{checkpoint.rstrip('/')}/open_panes",
                       lambda units: alert_batch(units, bid, state_root, min_samples, threshold, k, run), **kw)

    w = facts_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return w.trigger(**(trigger or {"processingTime": "30 minutes"})).start()


# --- ST9: rows behind the watermark ---------------------------------------------------

LATE_TABLES = {
    "late_rows": Table(StructType([*K.LOG_DATA.fields, StructField("event_ts", TimestampNTZType())])),
    "progress": Table("name string, latest timestamp_ntz", key="name"),
}


def late_store(spark: SparkSession, root: str) -> Store:
    """Where rows that came too late for their windows are kept."""
    return Store(spark, root, LATE_TABLES)


def late_batch(facts: DataFrame, batch_id: int, root: str, run: str = "late", watermark: str = "240 minutes",
               within_batch: bool = True) -> None:
    """Keep the rows that the windows of the same stream drop: those older than the newest row by more than the
    watermark. The newest row is that of the earlier batches or, ``within_batch``, of this one as well: needed
    where the two queries may cut the stream into different batches, and never wrong, as a window that is evaluated
    again without need gives the same."""
    store = late_store(facts.sparkSession, root)
    if store.has(run, batch_id):
        return
    rows = with_event_ts(facts).where(F.col("event_ts").isNotNull()).persist()
    try:
        before = store.newest("progress").first()
        before = before.latest if before else None
        newest = max(filter(None, (before, rows.agg(F.max("event_ts")).first()[0])), default=None)
        if newest is None:
            return
        bound = newest if within_batch else before
        late = rows.where(F.col("event_ts") < F.lit(bound).cast("timestamp_ntz") - F.expr(f"INTERVAL {watermark}"))
        progress = facts.sparkSession.createDataFrame([("facts", newest)], LATE_TABLES["progress"].struct)
        store.commit({"late_rows": late, "progress": progress}, run, batch_id)
    finally:
        rows.unpersist()


def start_late_rows(facts_stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None, **kw):
    """ST9 beside the window query: rows behind the watermark, kept for ``settled_rates``."""
    run = f"{zlib.crc32(checkpoint.encode()):08x}"
    w = (facts_stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: late_batch(df, bid, root, run, **kw)))
    return w.trigger(**(trigger or {"processingTime": "30 minutes"})).start()


def evaluate_again(facts: DataFrame, late: DataFrame, window: str = "240 minutes", slide: str = "30 minutes") -> DataFrame:
    """The rates of the windows that late rows fall in, from all facts; only the facts of these windows move."""
    start = lambda c: F.window(c, slide)["start"]
    touched = (late.select(F.window(F.col("event_ts").cast("timestamp"), window, slide).alias("w")).distinct())
    panes = touched.select(F.explode(F.sequence("w.start", F.col("w.end") - F.expr(f"INTERVAL {slide}"),
                                                F.expr(f"INTERVAL {slide}"))).alias("_pane")).distinct()
    rows = with_event_ts(facts).where(F.col("event_ts").isNotNull())
    rows = rows.withColumn("_pane", start(F.col("event_ts").cast("timestamp"))).join(panes, "_pane", "left_semi").drop("_pane")
    latest = _latest_per_window(rows, window, slide, "0 seconds", RATE_COLS).join(touched, "w", "left_semi")
    return _per_line(latest)


def settled_rates(rates: DataFrame, late: DataFrame, facts: DataFrame, window: str = "240 minutes",
                  slide: str = "30 minutes") -> DataFrame:
    """``rates`` as the stream gave them, but those of windows with late rows evaluated again: what the next evaluation
    of the reproduced system would count."""
    touched = late.select(F.window(F.col("event_ts").cast("timestamp"), window, slide)["start"]
                          .cast("timestamp_ntz").alias("window_start")).distinct()
    return rates.join(touched, "window_start", "left_anti").unionByName(evaluate_again(facts, late, window, slide))
