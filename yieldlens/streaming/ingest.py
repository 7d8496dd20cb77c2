"""ST1-ST6: continuous ingest of result files.

One file-stream source replaces the three detectors of the reproduced
system (event watcher, 1 s poll, 3 s rescan): the checkpointed source lists
each new file once. Every micro-batch is routed (P1-P7), files already in the
processed-file register are marked DUPLICATE (ST2), files that the source listed but that
were gone before they were read are recorded (P7), and the rows of all tables are one
commit (S6, ``sources.store``): a replayed batch changes nothing, and a
failed one is never seen in part.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import columns as C
from ..operators import ingest as I
from ..sources.files import ingest_store, listed_files, missing_files, staged, write_outcomes
from ..sources.store import Store

RAW_SCHEMA = "file_id string, filename string, content string, source string, file_mtime timestamp_ntz"


def stream_result_files(spark: SparkSession, path: str, max_files: int | None = None,
                        newest_first: bool = False, recursive: bool = False) -> DataFrame:
    """S2 + ST4 + ST5: new result files as a stream (whole text per file)."""
    r = (spark.readStream.format("text").option("wholetext", "true").option("ignoreMissingFiles", "true")
         .option("latestFirst", str(bool(newest_first)).lower()).option("recursiveFileLookup", str(bool(recursive)).lower()))
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.load(path)
    return (df.select(F.col("_metadata.file_path").alias("file_id"),
                      F.col("_metadata.file_name").alias("filename"),
                      C.decodable(F.col("value")).alias("content"), F.lit("watchdog").alias("source"),
                      F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("file_mtime"))
            .where(C.is_rslt_name(F.col("filename"))))


def stream_raw_rows(spark: SparkSession, path: str, max_files: int | None = None,
                    schema=None) -> DataFrame:
    """Stream of already-collected raw rows (parquet with the RAW_SCHEMA
    columns), e.g. files staged by an upstream collector. The schema is the
    staged table's own unless given."""
    schema = schema or spark.read.parquet(path).schema
    r = spark.readStream.schema(schema).format("parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def process_batch(batch: DataFrame, batch_id: int, root: str, run: str = "batch",
                  lag_seconds: int | None = None, listed: DataFrame | None = None) -> None:
    """ST1 + ST2 + ST6: route one micro-batch and commit its outcomes. The first copy of a file
    name that a batch confirms stays; copies in later batches are duplicates. With ``listed``, the files that the
    source listed for the batch, those that were gone before they were read are FILE_GONE (P7).
    A batch that is committed already is left out."""
    store = ingest_store(batch.sparkSession, root)
    if store.has(run, batch_id):
        return
    routed = staged(I.route(batch), store.root, run, I.ORDER)
    if listed is not None:
        gone = missing_files(listed.withColumn("content", F.lit(None).cast("string")), routed)
        gone = I.route(gone).withColumn("_place", F.lit(-1))
        here = routed.select("filename").distinct().withColumn("_here", F.lit(True))      # another copy was read
        gone = gone.join(here, "filename", "left").withColumn(
            "outcome", F.when(F.col("_here"), K.R_DUPLICATE).otherwise(F.col("outcome"))).drop("_here")
        routed = routed.unionByName(gone.select(*(F.col(f.name).cast(f.dataType) for f in routed.schema)))
    _commit_outcomes(store, routed, batch_id, run, lag_seconds)


def _commit_outcomes(store: Store, routed: DataFrame, batch_id: int, run: str, lag_seconds: int | None = None, **more) -> None:
    routed = _mark_seen(routed, store).persist()
    try:
        write_outcomes(store, routed, batch_id, run, lag_seconds, **more)
    finally:
        routed.unpersist()


def _mark_seen(routed: DataFrame, store: Store) -> DataFrame:
    """Routed rows whose file name an earlier batch confirmed become duplicates. Of the register, only the folders of
    the batch's names are read."""
    earlier = store.find("processed_files", routed).select("filename").distinct()
    seen = routed.join(earlier.withColumn("_seen", F.lit(True)), "filename", "left")
    return (seen.withColumn("outcome", F.when(F.col("_seen"), F.lit(K.R_DUPLICATE))
                            .otherwise(F.col("outcome"))).drop("_seen"))


def relay_batch(decoded: DataFrame, batch_id: int, root: str, run: str = "relay",
                order: tuple[str, ...] = ("partition", "offset")) -> None:
    """S4 + ST3, consumer side: one micro-batch of decoded envelopes (``kafka_source``). Records of
    names not confirmed before go to the fact table, records without a name all of them; values that are no JSON
    object are kept as dead letters with key and text."""
    store = ingest_store(decoded.sparkSession, root)
    if store.has(run, batch_id):
        return
    bad = decoded.where("bad_json").select(F.col("key").cast("string").alias("key"), "raw")
    routed = staged(I.from_relay(decoded, list(order)), store.root, run, list(order))
    _commit_outcomes(store, routed, batch_id, run, order=list(order), more={"dead_letters": bad})


def _run_name(checkpoint: str) -> str:
    """Batches are numbered per checkpoint, so the commits name the checkpoint as their run."""
    return f"{zlib.crc32(checkpoint.encode()):08x}"


def start_relay(decoded: DataFrame, root: str, checkpoint: str, trigger: dict | None = None):
    """Start the consumer of the relay; batches are numbered per checkpoint, as in ``start_ingest``."""
    run = _run_name(checkpoint)
    w = (decoded.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: relay_batch(df, bid, root, run)))
    return w.trigger(**(trigger or {"processingTime": "1 second"})).start()


def start_ingest(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None,
                 lag_seconds: int | None = None, result_files: bool = False):
    """Start the ingest query; ``trigger`` e.g. ``{"processingTime": "1 second"}``
    or ``{"availableNow": True}``. ``lag_seconds``: files inserted later than that after their
    modification count as late. ``result_files``: the stream is ``stream_result_files``, and what its source listed
    is settled against what was read, so that a file that left in between is recorded."""
    run = _run_name(checkpoint)

    def batch(df: DataFrame, bid: int) -> None:
        listed = listed_files(df.sparkSession, checkpoint, bid) if result_files else None
        process_batch(df, bid, root, run, lag_seconds, listed)

    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return w.trigger(**(trigger or {"processingTime": "1 second"})).start()


def dedup_stream(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """ST2, streaming-only form: drop repeated file names inside the watermark."""
    return (stream.withColumn("_t", F.col("file_mtime").cast("timestamp"))
            .withWatermark("_t", watermark).dropDuplicatesWithinWatermark(["filename"]).drop("_t"))
