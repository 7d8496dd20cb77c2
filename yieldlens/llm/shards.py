"""Sharding by sampled splitters (DataFrame functions only).

Records are ordered by (hash of the text, doc_id, place in the input), so equal
texts lie side by side. A size-weighted sample of these keys gives quantile
boundaries that range-partition the records into ``shards * RANGES`` ranges;
ranges that turn out overfull are sampled again and subdivided, so a text that
holds a third of all rows is spread over many ranges by its doc_ids. Exact sizes
per range and a running sum inside each range then give every record its place
in the byte order, and the shard is that place's fortieth of all bytes: shards
differ by less than one record at each end.

Edge cases: a null text has no bytes and the CRC of the empty string; a null
doc_id orders first; repeated rows are told apart by their place in the input and
all are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

RECORD_BYTES = 16        # counted beside the text of each record
RANGES = 16              # ranges a shard
SAMPLES = 8              # expected sample keys a range
OVERFULL = 2.5           # times the mean bytes of a range
ROUNDS = 4               # subdivisions at most
_KEY = ["h", "id", "place"]


def _literal(values: list, kind: str) -> Column:
    """An array constant, folded into the plan."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _key() -> Column:
    return F.struct(*_KEY)


def _range_of(splitters: list[dict]) -> Column:
    """How many splitters lie at or before the key: binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    steps = [1 << b for b in range(len(splitters).bit_length() - 1, -1, -1)]
    keys = _literal(splitters, "struct<h:bigint,id:bigint,place:bigint>")

    def step(at: Column, by: Column) -> Column:
        return at + F.when(F.get(keys, at + by - 1) <= _key(), by).otherwise(0)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _in_order(keys: list[dict]) -> list[dict]:
    order = lambda k: (k["h"], k["id"] is not None, k["id"] or 0, k["place"])
    out: list[dict] = []
    for k in sorted(keys, key=order):
        if not out or out[-1] != k:
            out.append(k)
    return out


def _sample(records: DataFrame, total: int, wanted: int, turn: int) -> list[dict]:
    """Keys drawn with a chance in proportion to size; about ``wanted`` of them."""
    chance = F.col("size") * wanted / F.lit(float(max(total, 1)))
    draw = (F.xxhash64(F.lit(turn), *_KEY).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40))
    rows = records.where(draw < chance).select(*_KEY).collect()      # about `wanted` narrow rows
    return _in_order([r.asDict() for r in rows])


def _quantiles(keys: list[dict], n: int) -> list[dict]:
    return _in_order([keys[len(keys) * k // n] for k in range(1, n)]) if keys else []


def splitters(records: DataFrame, total: int, ranges: int) -> tuple[list[dict], list]:
    """Range boundaries and (bytes, rows) of each range."""
    wanted = ranges * SAMPLES
    bounds = _quantiles(_sample(records, total, wanted, 0), ranges)
    for turn in range(1, ROUNDS + 2):
        ranged = records.withColumn("range", _range_of(bounds))
        filled = {r["range"]: (r["bytes"], r["rows"]) for r in ranged.groupBy("range")
                  .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}   # a row a range
        sizes = [filled.get(k, (0, 0)) for k in range(len(bounds) + 1)]
        over = [k for k, (b, n) in enumerate(sizes) if b > OVERFULL * total / ranges and n > 1]
        if not over or turn > ROUNDS:
            return bounds, sizes
        full = sum(sizes[k][0] for k in over)
        keys = _sample(ranged.where(F.col("range").isin(over)), full, -(-full * wanted // max(total, 1)), turn)
        bounds = _in_order(bounds + keys[::SAMPLES // 2])
    raise AssertionError("unreachable")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    records = stored(docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"),
                                 (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
                                 F.crc32(text).alias("crc"), F.monotonically_increasing_id().alias("place")),
                     "shard-records")
    total = records.agg(F.sum("size")).first()[0] or 0
    bounds, sizes = splitters(records, total, shards * RANGES)
    starts, firsts = [0], [0]
    for b, n in sizes:
        starts.append(starts[-1] + b)
        firsts.append(firsts[-1] + n)
    inside = Window.partitionBy("range").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = records.withColumn("range", _range_of(bounds)).select(
        "*", (F.get(_literal(starts, "bigint"), F.col("range")) + F.sum("size").over(inside) - F.col("size")).alias("at"),
        (F.get(_literal(firsts, "bigint"), F.col("range")) + F.row_number().over(inside) - 1).alias("rank"))
    middle = F.col("at") + F.floor(F.col("size") / 2)
    placed = stored(placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(
        middle.cast("decimal(38,0)") * shards / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("int"))), "shard-placed")
    heads = {r["shard"]: r["head"] for r in placed.groupBy("shard").agg(F.min("rank").alias("head")).collect()}
    head = F.get(_literal([heads.get(k, 0) for k in range(shards)], "bigint"), F.col("shard"))
    return placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"),
                         F.lit("bytes").alias("law"), "shard", (F.col("rank") - head).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
