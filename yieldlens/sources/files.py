"""File and table sources / sinks.

Connector options always come from the caller; nothing here carries
credentials or addresses.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as K
from ..functions import columns as C
from .store import FANOUT, Store, Table, bucket_of, numbered


def read_result_files(spark: SparkSession, path: str, recursive: bool = False,
                      source: str = "startup") -> DataFrame:
    """Every file whose base name contains ``rslt`` (any case), whole
    text per file, with file name, modification time and the detection
    source tag. Undecodable bytes are dropped, and a file that is gone
    between listing and reading is skipped; neither is fatal."""
    # text() sets wholetext from its own argument, so pass it there
    df = spark.read.option("ignoreMissingFiles", "true").text(path, wholetext=True, recursiveFileLookup=recursive)
    return (df.select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_name").alias("filename"),
        C.decodable(F.col("value")).alias("content"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("file_mtime"),
        F.lit(source).alias("source"))
        .where(C.is_rslt_name(F.col("filename"))))


def list_result_files(spark: SparkSession, path: str, recursive: bool = False, source: str = "startup") -> DataFrame:
    """The result files there are, without reading them. Store it to find files that are
    gone by the time they are read."""
    df = (spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
          .option("recursiveFileLookup", str(recursive).lower()).load(path))
    return (df.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_name").alias("filename"),
                      F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("file_mtime"),
                      F.lit(source).alias("source"))
            .where(C.is_rslt_name(F.col("filename"))))


def with_gone(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``files`` as read, and a row without content for each file of an earlier, stored
    ``listing`` that the read did not find; ``route`` gives those FILE_GONE."""
    gone = missing_files(listing, files)
    return files.unionByName(gone.withColumn("content", F.lit(None).cast("string")))


def listed_files(spark: SparkSession, checkpoint: str, batch_id: int, source: str = "watchdog") -> DataFrame | None:
    """The result files that a file stream listed for a batch, by the log that it keeps in its checkpoint before it
    reads: file_id, filename, file_mtime, source. None if the checkpoint has no such log."""
    def lines(path: str) -> list[str] | None:
        try:
            return [r[0] for r in spark.read.text(path).collect()]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def upto(batch: int) -> int:
        text = "".join(lines(f"{checkpoint}/offsets/{batch}") or []) if batch >= 0 else ""
        found = re.search(r'"logOffset":(-?\d+)', text)
        return int(found[1]) if found else -1

    rows = []
    for k in range(upto(batch_id - 1) + 1, upto(batch_id) + 1):
        name = next((n for n in (f"{k}", f"{k}.compact") if lines(f"{checkpoint}/sources/0/{n}") is not None), None)
        if name is None:
            return None
        entry = F.from_json("value", "path string, timestamp long, batchId long")
        rows.append(spark.read.text(f"{checkpoint}/sources/0/{name}").select(entry.alias("e")).select("e.*")
                    .where(F.col("batchId") == k))
    if not rows:
        return None
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return (out.where(F.col("path").isNotNull())
            .select(F.col("path").alias("file_id"), name.alias("filename"),
                    F.timestamp_millis("timestamp").cast("timestamp_ntz").alias("file_mtime"), F.lit(source).alias("source"))
            .where(C.is_rslt_name(F.col("filename"))))


def missing_files(listing: DataFrame, read: DataFrame) -> DataFrame:
    """Files of ``listing`` that are not among those ``read``, compared by path (the slashes after the scheme vary)."""
    path = F.regexp_replace("file_id", "^(\\w+):/+", "$1:/")
    return (listing.withColumn("_path", path)
            .join(read.select(path.alias("_path")), "_path", "left_anti").drop("_path"))


def read_facts(spark: SparkSession, path: str | None = None, jdbc_options: dict | None = None,
               num_partitions: int = 64) -> DataFrame:
    """The fact table, from parquet (``path``) or over JDBC. The JDBC
    read is split on the ``id`` column so it is not a single-task scan."""
    if path is not None:
        return spark.read.parquet(path)
    opts = dict(jdbc_options or {})
    if "partitionColumn" not in opts and "lowerBound" in opts and "upperBound" in opts:
        opts.setdefault("partitionColumn", "id")
        opts.setdefault("numPartitions", str(num_partitions))
    opts.setdefault("dbtable", "log_data")
    return spark.read.format("jdbc").options(**opts).load()


def write_facts(records: DataFrame, path: str, mode: str = "append") -> None:
    """Fact sink: parquet partitioned by event date with the canonical
    ``event_ts`` stored, so the trailing-window filter is on a bare column and date filters prune whole
    directories. Files are in the order of time, which lets row groups be skipped, and have a Bloom filter on the track."""
    ts = C.parse_iso_ts(C.normalized_ts_text())
    out = records.withColumn("event_ts", ts).withColumn("event_date", F.to_date("event_ts"))
    (out.sortWithinPartitions("event_date", "event_ts").write.mode(mode)
     .option("parquet.bloom.filter.enabled#track_id", "true").partitionBy("event_date").parquet(path))


# --- S6 / S10: the tables of the ingest job -----------------------------------------------

FACTS = ("filename string, source string, process string, model string, line string, station string, "
         "status string, failed_testcode string, track_id string, date string, time string, "
         "timestamp string, event_ts timestamp_ntz, id long, event_date date")
TABLES = {
    "log_data": Table(FACTS, partition=("event_date",), sort=("event_ts",), bloom=("track_id",)),
    "skip_log": Table("filename string, reason string, process string, track_id string, timestamp string"),
    "no_th4_files": Table("filename string, track_id string"),
    "file_gone_log": Table("filename string, track_id string, source string"),
    "duplicate_files": Table("filename string, source string"),
    "rescan_tracking": Table("filename string, track_id string, process string"),
    "processed_files": Table("filename string, processed_time timestamp_ntz, bucket int", partition=("bucket",),
                             sort=("filename",), bloom=("filename",)),
    "dead_letters": Table("key string, raw string"),
}


def ingest_store(spark: SparkSession, root: str, fanout: int = FANOUT) -> Store:
    """The tables that the ingest job keeps under ``root``."""
    return Store(spark, root, TABLES, fanout)


def staged(routed: DataFrame, root: str, run: str, order: list[str]) -> DataFrame:
    """Routed rows, stored once for the writes of a batch (a lost executor changes nothing of what was read), with
    ``_place``, the range of ``order`` that a row lies in. The next batch of the run takes its place."""
    path = f"{root}/_staged/{run}"
    rows = routed.repartitionByRange(*order).withColumn("_place", F.spark_partition_id())
    rows.write.mode("overwrite").parquet(path)
    return routed.sparkSession.read.schema(rows.schema).parquet(path)


def write_outcomes(store: Store, routed: DataFrame, batch_id: int, run: str = "batch", lag_seconds: int | None = None,
                   processed_at=None, order: list[str] | None = None, more: dict | None = None) -> None:
    """S6 + S10: one commit with a batch's rows of all tables (and of ``more``): readers find all or none of them.
    Facts get ids in insertion order (``order``, batch after batch), without gaps. ``routed``
    comes from ``staged``."""
    from ..operators import ingest as I
    counts = {r[0]: r[1] for r in routed.groupBy("outcome").count().collect()}
    inserted = routed.where(F.col("outcome") == K.INSERT)
    first = store.next_id()
    facts = numbered(I.records(routed, "_place", *(order or I.ORDER)), "_place", order or I.ORDER, first)
    confirmed = routed.where((F.col("outcome") != K.R_DUPLICATE) & (F.col("filename") != ""))
    tables = {                                               # each with the outcomes that give it rows
        "log_data": ((K.INSERT,), facts.withColumn("event_date", F.to_date("event_ts"))),
        "skip_log": ((K.R_PROCESS, K.R_PARSE_ERR), I.skip_log(routed)),
        "no_th4_files": ((K.R_NO_TH4,), routed.where(F.col("outcome") == K.R_NO_TH4)),
        "file_gone_log": ((K.R_FILE_GONE,), routed.where(F.col("outcome") == K.R_FILE_GONE)),
        "duplicate_files": ((K.R_DUPLICATE,), routed.where(F.col("outcome") == K.R_DUPLICATE)),
        "rescan_tracking": ((K.INSERT,), I.late_caught(inserted, lag_seconds, processed_at)),
        "processed_files": (counts.keys() - {K.R_DUPLICATE}, confirmed.select(
            "filename", F.current_timestamp().cast("timestamp_ntz").alias("processed_time"),
            bucket_of("filename").alias("bucket"))),
    }
    rows = {name: df for name, (outcomes, df) in tables.items() if any(counts.get(o) for o in outcomes)}
    store.commit({**rows, **(more or {})}, run, batch_id, first + counts.get(K.INSERT, 0))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the ingest job; one without rows so far reads as empty."""
    return ingest_store(spark, root).read(name)
