"""Small DataFrame combinators shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def single_row(*frames: DataFrame) -> DataFrame:
    """Merge one-row aggregates side by side without a join: stack them with
    missing columns null, then take the only non-null value of each column."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    cols = [c for f in frames for c in f.columns]
    return out.agg(*[F.max(c).alias(c) for c in cols])


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row of ``df`` as a
    scalar subquery (evaluated once, no join of any kind). The columns are
    packed into one struct so the aggregate runs a single time."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_one")).scalar()
    return df.select("*", packed.alias("_one")).select(
        *[F.col(c) for c in df.columns], *[F.col(f"_one.{c}").alias(c) for c in one_row.columns])
