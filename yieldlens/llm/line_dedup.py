"""Exact line dedup with levelled sorted runs (DataFrame functions only).

Documents arrive in batches of ascending doc_id. A batch's line hashes are
reduced to one row per line (its smallest doc_id in the batch, and whether others
hold it), anti-joined against the runs written so far, and what is new is written
as a sorted run of level 0. ``FANOUT`` runs of a level are merged into one run of
the next, so a line is rewritten once a level and a batch meets few runs. Since
earlier batches hold smaller ids, a line found in a run is dropped from the whole
batch, and one that is new stays only in its smallest document.

Only hashes are shuffled. A line to drop is known by its document's key (doc_id and a hash of the text)
and its place; the places are gathered per document and the texts are read once more to leave those
lines out, in time linear in their lines.

Edge cases: a null or empty text is one empty line; lines shorter than
``MIN_CHARS`` code points once stripped are never dropped; a line repeated inside
its smallest document stays each time; rows that share a doc_id are one document;
rows with a null doc_id are one document after all others; an empty table gives
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, stored

MIN_CHARS = 10
FANOUT = 2
BATCHES = 4
_SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h1", "h2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _row_key() -> list[Column]:
    """What names a document row: equal rows lose the same lines."""
    return [F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))]


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """id, row, place, h1, h2: the long enough lines of each document row."""
    id_, row = _row_key()
    lines = (docs.select(id_.alias("id"), row.alias("row"), _lines(F.col("text")).alias("lines"))     # hashed before the lines part
             .select("id", "row", F.posexplode("lines").alias("place", "line")))
    keys = lines.select("id", "row", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("id", "row", "place", *_hashes(F.col("key")))


class Runs:
    """Levels of sorted runs of (h1, h2, owner), as Parquet under the shared folder."""

    def __init__(self, spark):
        self.spark, self.levels = spark, [[]]

    def _write(self, rows: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "line-run")
        rows.repartition(*(F.col(c) for c in _HASH)).sortWithinPartitions(*_HASH).write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, rows: DataFrame) -> None:
        self.levels[0].append(self._write(rows))
        for k, level in enumerate(self.levels):
            if len(level) >= FANOUT:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(reduce(DataFrame.unionByName, level)))
                self.levels[k] = []


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """id, row, place: the lines that each document row loses."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    batch = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    batch = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(batch)
    lines = stored(hashed_lines(docs, min_chars).withColumn("batch", batch), "line-hashes")
    runs, dropped = Runs(spark), []
    for k in range(len(cuts) + 2):
        here = lines.where(F.col("batch") == k).drop("batch")
        keys = stored(here.groupBy(*_HASH).agg(F.min("id").alias("owner"), (F.min("id") < F.max("id")).alias("shared")),
                      "line-keys")
        # merge-anti-join: what the runs hold is old, whoever owns it there
        held = [keys.join(run.select(*_HASH), _HASH, "left_semi") for run in runs.all()]
        old = stored(reduce(DataFrame.unionByName, held), "line-old") if held else None
        new = keys.join(old.select(*_HASH), _HASH, "left_anti") if held else keys
        new = stored(new, "line-new")
        runs.add(new.select(*_HASH, "owner"))
        lost = new.where("shared").select(*_HASH, "owner")
        if held:
            lost = lost.unionByName(old.select(*_HASH, F.lit(None).cast("long").alias("owner")))
        dropped.append(here.join(stored(lost, "line-lost"), _HASH)
                       .where(~F.col("id").eqNullSafe(F.col("owner")) | F.col("id").isNull()).select("id", "row", "place"))
    return reduce(DataFrame.unionByName, dropped)


def _with_kept(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """``docs`` with __lines and __kept, the lines before and after."""
    drop = (dropped_lines(docs, min_chars, batches).groupBy("id", "row")
            .agg(F.collect_set("place").alias("__drop")))    # of one text's lines
    drop = stored(drop.withColumnsRenamed({"id": "__id", "row": "__row"}), "line-drop")
    id_, row = _row_key()
    joined = docs.join(drop, id_.eqNullSafe(F.col("__id")) & (row == F.col("__row")), "left")
    joined = joined.withColumn("__lines", _lines(F.col("text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))    # by a hash set, in order
    # lines and places as one value, so that the text is split once and not for each line
    both = F.array(F.struct(F.col("__lines").alias("lines"), places.alias("places")))
    chosen = F.transform(both, lambda x: F.transform(x["places"], lambda k: F.get(x["lines"], k)))
    kept = F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(F.get(chosen, 0))
    return joined.withColumn("__kept", kept)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped and text (the lines that stay, joined): one row per row of ``docs``."""
    n = F.size("__lines").cast("long")
    return _with_kept(docs, min_chars, batches).select(
        "doc_id", n.alias("n_lines"), (n - F.size("__kept")).alias("n_dropped"),
        F.array_join("__kept", "\n").alias("text"))


def without_copied_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """The rows and columns of ``docs`` with the lines that stay as text, and n_chars, if there, to match."""
    text = F.array_join("__kept", "\n")
    new = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)}
                            if "n_chars" in docs.columns else {})
    return _with_kept(docs, min_chars, batches).select(
        *(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))
