"""Tables that change together: commits, state that can change, and compaction (S6, S10, ST1, ST8).

The reproduced system writes the tables of a batch in one transaction and updates rows in place. Here
a batch writes each table into a folder of its own attempt, and then one commit row that names the
folder. Readers take the folders of commits only, so no reader ever sees a part of a batch, and what a
failed attempt left behind is never read. A batch is known by the query that runs it and its number; one
that is committed already (a replayed micro-batch) is left out.

State tables (with a ``key``) are logs of versions: a changed row is written again, and readers fold
the log to the newest version of each key.

Commits have levels. ``FANOUT`` commits of a level are rewritten as one of the next, so
both the commits a reader opens and the times a row is rewritten grow with the logarithm of the
batches. A rewrite is a commit as well: readers see the old folders or the new one. Replaced folders
stay until ``vacuum``, for readers that opened them before.

One writer at a time commits to a root, as with the reproduced system's database file; a second one
that commits in between is noticed and the batch fails, to be run again.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

FANOUT = 16              # commits of a level that are rewritten as one of the next
BUCKETS = 64             # folders of a table that is looked up by name
COMMIT = ("seq long, part string, level int, tables array<string>, next_id long, at double, replaces array<long>, "
          "runs array<struct<run:string,first:long,last:long>>")


@dataclass(frozen=True)
class Table:
    """A table of a store: its columns, folders within a commit, the key of a state table, the
    order of rows in a file, and columns with a Bloom filter."""
    schema: StructType | str
    partition: tuple[str, ...] = ()
    key: str | None = None
    sort: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()

    @property
    def struct(self) -> StructType:
        return self.schema if isinstance(self.schema, StructType) else StructType.fromDDL(self.schema)

    def stored(self) -> StructType:
        more = [StructField("version", LongType())] if self.key else []
        return StructType([*self.struct.fields, *more, StructField("part", StringType())])


def bucket_of(name: str | Column) -> Column:
    """The folder of a name in a table that is looked up by it."""
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def read_if_written(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The table of ``schema`` at ``path`` (it may have no rows yet), or None if there is no
    such path; other errors are raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], fanout: int = FANOUT):
        self.spark, self.root, self.tables, self.fanout = spark, root.rstrip("/"), tables, fanout

    # -- what is there ---------------------------------------------------------

    def _log(self) -> list[Row]:
        rows = read_if_written(self.spark, f"{self.root}/_commits", COMMIT)
        return [] if rows is None else rows.collect()        # few: compaction and vacuum keep them so

    def commits(self) -> list[Row]:
        """The commits that readers take, oldest first."""
        return _live(self._log())

    def has(self, run: str, batch_id: int) -> bool:
        """Whether the batch is committed."""
        return _has(self.commits(), run, batch_id)

    def next_id(self) -> int:
        """The first id that no committed batch has used."""
        return max((c.next_id for c in self.commits()), default=1)

    def read(self, name: str) -> DataFrame:
        """All committed rows of a table; of a state table, all versions."""
        return self._parts(name, [c.part for c in self.commits() if name in c.tables])

    def _parts(self, name: str, parts: list[str]) -> DataFrame:
        schema = self.tables[name].stored()
        if not parts:
            return self.spark.createDataFrame([], schema).drop("part")
        base = f"{self.root}/{name}"
        return (self.spark.read.schema(schema).option("basePath", base)
                .parquet(*(f"{base}/part={p}" for p in parts)).drop("part"))

    def newest(self, name: str) -> DataFrame:
        """The current rows of a state table: the newest version of each key."""
        return _fold(self.read(name), self.tables[name]).drop("version")

    def find(self, name: str, names: DataFrame) -> DataFrame:
        """Rows of a table with ``bucket`` folders whose ``filename`` is among ``names``; only the
        folders that can hold them are read."""
        wanted = names.select("filename").distinct()
        folders = [r[0] for r in wanted.select(bucket_of("filename")).distinct().collect()]     # BUCKETS at most
        return self.read(name).where(F.col("bucket").isin(folders)).join(wanted, "filename", "left_semi")

    # -- commits ---------------------------------------------------------------

    def _write(self, rows: DataFrame, name: str, part: str, pack: bool = False) -> None:
        """Rows of a table with folders are brought together by folder first, so that a commit has about a file a
        folder and not one for each task; a Bloom filter is as large as the values of its file ask for."""
        table = self.tables[name]
        if pack or table.partition:                          # files of the advisory size, whatever came in
            rows = rows.hint("rebalance", *table.partition)
        if table.sort:
            rows = rows.sortWithinPartitions(*table.partition, *table.sort)
        out = rows.write.mode("overwrite")
        for c in table.bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        out.partitionBy(*table.partition).parquet(f"{self.root}/{name}/part={part}")

    def _commit(self, seq: int, part: str, **fields) -> list[Row]:
        """Write a commit row; the log with it."""
        log = self._log()
        if _last(log) >= seq:
            raise RuntimeError(f"another writer committed to {self.root}: run the batch again")
        row = {"part": part, "at": time.time(), **fields}
        schema = StructType([f for f in StructType.fromDDL(COMMIT).fields if f.name != "seq"])
        (self.spark.createDataFrame([tuple(row[f.name] for f in schema.fields)], schema).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.root}/_commits/seq={seq}"))
        return [*log, Row(seq=seq, **{**row, "runs": [Row(run=r, first=f, last=t) for r, f, t in row["runs"]]})]

    def commit(self, tables: dict[str, DataFrame], run: str, batch_id: int, next_id: int | None = None) -> bool:
        """Write the rows of a batch to their tables, all or none; False if the batch is committed already.
        Rows of a state table are the new and changed ones."""
        log = self._log()
        if _has(_live(log), run, batch_id):
            return False
        seq, part = _attempt(log)
        for name, rows in tables.items():
            table = self.tables[name]
            rows = rows.select(*table.struct.fieldNames())
            self._write(rows.withColumn("version", F.lit(seq).cast("long")) if table.key else rows, name, part)
        next_id = next_id or max((c.next_id for c in log), default=1)
        self.compact(self._commit(seq, part, level=0, tables=list(tables), next_id=next_id, replaces=[],
                                  runs=[(run, batch_id, batch_id)]))
        return True

    # -- compaction ------------------------------------------------------------

    def compact(self, log: list[Row] | None = None) -> int:
        """Rewrite full levels; the number of rewrites."""
        done, log = 0, self._log() if log is None else log
        while True:
            levels: dict[int, list[Row]] = {}
            for c in _live(log):
                levels.setdefault(c.level, []).append(c)
            full = [k for k, group in sorted(levels.items()) if len(group) >= self.fanout]
            if not full:
                return done
            log = self._merge(log, levels[full[0]][:self.fanout], full[0] + 1)
            done += 1

    def _merge(self, log: list[Row], group: list[Row], level: int) -> list[Row]:
        seq, part = _attempt(log)
        names = [n for n in self.tables if any(n in c.tables for c in group)]
        for name in names:
            rows = self._parts(name, [c.part for c in group if name in c.tables])
            self._write(_fold(rows, self.tables[name]) if self.tables[name].key else rows, name, part, pack=True)
        runs: dict[str, list[int]] = {}
        for r in (r for c in group for r in c.runs):
            runs.setdefault(r.run, []).extend((r.first, r.last))
        return self._commit(seq, part, level=level, tables=names, next_id=max(c.next_id for c in group),
                            replaces=[c.seq for c in group], runs=[(r, min(b), max(b)) for r, b in runs.items()])

    def vacuum(self, keep_seconds: float = 3600.0) -> int:
        """Delete folders that were replaced, or left by a failed attempt, more than ``keep_seconds`` ago, and
        return their number. Readers and attempts last no longer than that."""
        log = self._log()
        until = time.time() - keep_seconds
        old = {s for c in log if c.at <= until for s in c.replaces}
        live = {c.part for c in log if c.seq not in old}
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        removed = 0

        def folders(path: str, prefix: str) -> list[tuple[str, float, object]]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            fs = p.getFileSystem(conf)
            if not fs.exists(p):
                return []
            return [(s.getPath().getName().removeprefix(prefix), s.getModificationTime() / 1000, (fs, s.getPath()))
                    for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)]

        for seq, _, (fs, p) in folders(f"{self.root}/_commits", "seq="):
            if int(seq) in old:                              # first, so that no reader finds a commit without its folder
                removed += bool(fs.delete(p, True))
        for name in self.tables:
            for part, changed, (fs, p) in folders(f"{self.root}/{name}", "part="):
                if part not in live and changed <= until:
                    removed += bool(fs.delete(p, True))
        return removed


def _live(log: list[Row]) -> list[Row]:
    gone = {s for c in log for s in c.replaces}
    return sorted((c for c in log if c.seq not in gone), key=lambda c: c.seq)


def _has(commits: list[Row], run: str, batch_id: int) -> bool:
    return any(r.run == run and r.first <= batch_id <= r.last for c in commits for r in c.runs)


def _last(log: list[Row]) -> int:
    return max((c.seq for c in log), default=0)


def _attempt(log: list[Row]) -> tuple[int, str]:
    """The number of the next commit, and a folder name that no other attempt has."""
    return _last(log) + 1, f"{_last(log) + 1:012d}-{uuid.uuid4().hex[:8]}"


def _fold(rows: DataFrame, table: Table) -> DataFrame:
    """The newest version of each key."""
    columns = [*table.struct.fieldNames(), "version"]
    return rows.groupBy(F.col(table.key).alias("_key")).agg(F.max_by(F.struct(*columns), "version").alias("_r")).select("_r.*")


def changed(after: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows of ``after`` that are new or differ from the row of the same key in ``before``."""
    names = after.columns
    old = before.select(F.col(key).alias("_k"), F.struct(*names).alias("_old"))
    same = F.col("_old").isNotNull() & reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_old.{c}")) for c in names))
    return after.join(old, F.col(key) == F.col("_k"), "left").where(~same).select(*names)


def numbered(rows: DataFrame, place: str, order: list[str], first: int) -> DataFrame:
    """``rows`` with ``id``: from ``first`` on without gaps, by ``place`` (the range of ``order`` that a row
    lies in) and ``order``. ``rows`` is a stored table, so that both passes see the same places."""
    counts = rows.groupBy(place).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(place, before.alias("_start"))    # a row a range: as many as one shuffle has partitions
    nth = F.row_number().over(Window.partitionBy(place).orderBy(*order))
    return (rows.withColumn("_nth", nth).join(starts, place)
            .withColumn("id", (F.lit(first - 1) + F.col("_start") + F.col("_nth")).cast("long")).drop("_start", "_nth"))
