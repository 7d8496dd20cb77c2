"""SimHash near-dedup with pivot distance tables.

``fingerprints``: 64-bit SimHash of every text over word shingles.
``near_duplicates``: classes of documents whose fingerprints are linked by
chains of at most ``max_bits`` differing bits.

Method. Distances to fixed reference fingerprints are computed once per
distinct fingerprint, separately on ``max_bits + 2`` bit blocks. Hamming
distance is the sum of the block distances, so two linked fingerprints agree on
at least two whole blocks, and there their reference distances are equal:
rows meet by an equi-join on the distances of two blocks. By the triangle
inequality no reference distance of a linked pair differs by more than
``max_bits``, so pairs with a larger coordinate difference are discarded
unseen, and the survivors are verified on the fingerprints themselves.

A bucket of more than ``BUCKET`` fingerprints is never paired up. Its members
go by an exact linear way: two fingerprints are at most 2 bits apart if and only
if some 64-bit value is at most one flip from both, so each member joins the 65
values around it and links to the smallest member at each value.

Edge cases: a null text counts as empty; a text without words has fingerprint
zero and links like any other; a null doc_id takes part, its component_id is the
smallest non-null doc_id of its class (null if there is none); repeated rows
are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow_map, connected_components, stored

REFERENCES = 8          # reference fingerprints per block; their distances fill one long
BUCKET = 32             # largest bucket whose members are paired
_STEP = 65536           # shingles whose bits are counted at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64 (seed 42), unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, last, _STEP):
        part = words[lo:min(lo + _STEP, last) + shingle - 1]
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), 42)
                  for x in (zip(*(part[k:] for k in range(shingle))) if len(words) >= shingle else [words])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp as a signed long."""
    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run,
                     "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(n: int) -> list[int]:
    edges = [64 * k // n for k in range(n + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def _references() -> list[int]:
    return [xxhash.xxh64_intdigest(b"reference %d" % k, 42) for k in range(REFERENCES)]


def pivot_table(fps: DataFrame, max_bits: int) -> DataFrame:
    """fp and, per block, its distances to the references: one byte each in a long (c0, c1, ...)."""
    def distances(mask: int) -> Column:
        packed = F.lit(0).cast("long")
        for k, ref in enumerate(_references()):
            d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(ref))).bitwiseAND(F.lit(_signed(mask))))
            packed = packed.bitwiseOR(F.shiftleft(d.cast("long"), 8 * k))
        return packed

    return fps.select("fp", *(distances(m).alias(f"c{b}") for b, m in enumerate(_blocks(max_bits + 2))))


def _coordinates_close(x: Column, y: Column, max_bits: int) -> Column:
    byte = lambda c, k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))
    return F.greatest(*(F.abs(byte(x, k) - byte(y, k)) for k in range(REFERENCES))) <= max_bits


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of all
    pairs at most ``max_bits`` apart."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    n = max_bits + 2
    bands = list(combinations(range(n), 2))
    table = pivot_table(fps, max_bits).select("fp", F.explode(F.array(*(
        F.struct(F.lit(k).alias("band"), F.col(f"c{i}").alias("k1"), F.col(f"c{j}").alias("k2"),
                 *(F.col(f"c{b}").alias(f"r{q}") for q, b in enumerate(b for b in range(n) if b not in (i, j))))
        for k, (i, j) in enumerate(bands)))).alias("x")).select("fp", "x.*")
    key, rest = ["band", "k1", "k2"], [f"r{q}" for q in range(n - 2)]
    shared = stored(table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    met = stored(table.join(shared, key), "simhash-met")

    small = met.where(F.col("n") <= BUCKET)
    other = small.select(*key, F.col("fp").alias("fp2"), *(F.col(r).alias(f"{r}_2") for r in rest))
    pairs = small.join(other, key).where("fp < fp2")
    for r in rest:
        pairs = pairs.where(_coordinates_close(F.col(r), F.col(f"{r}_2"), max_bits))
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits)
    pairs = pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b"))

    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)))
    hubs = (met.where(F.col("n") > BUCKET).select("fp").distinct().select("fp", F.explode(around).alias("hub"))
            .groupBy("hub").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1))   # 65 at most
    if max_bits == 1:
        hubs = hubs.where(F.array_contains("fps", F.col("hub"))).withColumn("to", F.col("hub"))
    else:
        hubs = hubs.withColumn("to", F.array_min("fps"))
    stars = hubs.select(F.explode("fps").alias("a"), F.col("to").alias("b")).where("a <> b")
    return pairs.unionByName(stars.where(F.lit(max_bits > 0)))


def _classified(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """doc_id, fp, class (one fingerprint of it) and component_id: one row per row of ``docs``."""
    rows = stored(fingerprints(docs, shingle), "simhash-rows")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    comps = stored(connected_components(links(classes.select("fp"), max_bits)), "simhash-components")
    linked = classes.join(comps, classes.fp == comps.node).select("fp", "first", "root")
    firsts = stored(linked.groupBy("root").agg(F.min("first").alias("lowest")), "simhash-lowest")
    lowest = comps.join(firsts, "root").select(F.col("node").alias("fp"), "root", "lowest")
    ids = stored(classes.join(lowest, "fp", "left")
                 .select("fp", F.coalesce("root", "fp").alias("class"),
                         F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("lowest")).alias("component_id")),
                 "simhash-ids")
    return rows.join(ids, "fp").select("doc_id", "fp", "class", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``."""
    return _classified(docs, shingle, max_bits).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``docs`` for each class: of its smallest doc_id and, where that has several texts in the class, one with the
    smallest fingerprint. A doc_id whose texts are in several classes may stand for each of them. Rows without a
    doc_id cannot be named and all stay."""
    found = stored(_classified(docs.where(F.col("doc_id").isNotNull()), shingle, max_bits), "simhash-found")
    leads = (found.where(F.col("doc_id") == F.col("component_id")).groupBy("class", "doc_id")
             .agg(F.min("fp").alias("fp")).select("doc_id", "fp"))
    rows = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    leads = stored(leads.join(rows, "doc_id").select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"), "n"),
                   "simhash-leads")
    named = docs.where(F.col("doc_id").isNotNull())
    key = named["doc_id"].cast("long") == F.col("__id")
    # never by broadcast: else the texts begin to be shuffled at some size of the table, and disk use leaps there
    single = named.join(leads.where("n = 1").hint("merge"), key, "left_semi")
    repeated = stored(rows.where("n > 1").select(F.col("doc_id").alias("__id")), "simhash-repeated")

    def run(batches):                                        # the texts of ids that have several rows
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], np.uint64)
            yield batch.append_column("__text", pa.array(fps.view(np.int64)))

    at = docs.columns.index("text")
    several = arrow_map(named.join(repeated, key, "left_semi"), run,
                        StructType([*docs.schema.fields, StructField("__text", LongType())]))
    several = several.join(leads.where("n > 1"), (several["doc_id"].cast("long") == F.col("__id"))
                           & (F.col("__text") == F.col("__fp")), "left_semi")
    several = several.dropDuplicates(["doc_id", "__text"]).drop("__text")
    return single.unionByName(several).unionByName(docs.where(F.col("doc_id").isNull()))
