import math

import numpy as np
from pyspark.sql import functions as F

from yieldlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank int, score double"


def expected(rows, k):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % 20 == 0}):
        scores = [(-sum(a * b for a, b in zip(v, w)), j) for i, v in fine if i == q for j, w in fine if j != q]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return out


def check(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in topk.top_inner_products(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect()]
    assert got == expected(rows, k)


def vectors(n, dim, seed, spread):
    draw = np.random.default_rng(seed)
    v = draw.normal(size=(n, dim)) * np.exp(draw.normal(size=(n, 1)) * spread)
    return [(k, x) for k, x in enumerate(v.astype(np.float32).tolist())]


def test_norms_alike_and_unlike(spark, monkeypatch):
    check(spark, vectors(700, 16, 1, 0))
    monkeypatch.setattr(topk, "HEAD", 30)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)                         # several blocks
    monkeypatch.setattr(topk, "STEP", 64)
    check(spark, vectors(700, 16, 2, 1.5), 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]),
            (80, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, []), (3, [-0.001, 5.0]), (120, [1e6, -1e6])]
    check(spark, rows)
    check(spark, rows, 1)
    assert topk.top_inner_products(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
