"""Helpers shared by the training-data operators: shared intermediate tables,
worker imports, Arrow map functions and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.
    Where it is unset a local-mode session (tests) gets a temporary one; any
    other session fails, because a machine's own folder would not be shared."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="yieldlens-llm-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read back: cuts
    lineage, survives lost executors, and gives joins plain scans on both sides
    (which adaptive execution can split when a key is hot)."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Lets the workers of functions made from now on import this package."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_REPO, *filter(None, paths)])


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with this package importable in the workers."""
    importable(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in turn, with about ``most`` bytes in ``column`` at a time."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.nan_to_num(sizes.astype(np.float64)))
    cuts = np.flatnonzero(np.diff(ends // most)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        # a copy: Arrow's string functions misread parts of a batch once cast
        yield batch.take(pa.array(np.arange(lo, hi))) if hi - lo < len(sizes) else batch


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; null-free longs),
    root the smallest node reachable.

    Alternating large-star / small-star rounds: each is a map-side combined
    ``min`` per node and a join back, so a star of any size is split across
    tasks; the edge set is stored after each step."""
    def least_neighbour(e: DataFrame) -> DataFrame:
        return stored(e.groupBy("a").agg(F.min("b").alias("m")), "cc-min")

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .distinct(), "cc-edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least_neighbour(both).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        e = stored(large, "cc-large")
        low = least_neighbour(e)
        e = stored(e.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct(), "cc-small")
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("s"),
                    F.bit_xor(F.xxhash64("b", "a")).alias("t")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    child = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return child.unionByName(child.select(F.col("root").alias("node"), "root").distinct())
