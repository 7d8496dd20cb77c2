import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from yieldlens.llm import quality

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    told = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in told) >= 0.95 * len(told)
    # turning the held-out labels, and the other columns of documents, changes no score
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0,
                                                 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None))
    again = quality.score(other, quality.train(other, turned)).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in got}


def test_rejected_documents_go(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    scores = {r.doc_id: r.predicted for r in quality.score(docs, model).collect()}
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, p in scores.items() if p)


def test_odd_rows(spark, odd_docs, no_docs):
    schema = "doc_id long, quality int, text string"
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, None), (None, 1, None), (5, None, None), (6, 0, None)], schema)
    model = quality.train(odd_docs, labels)
    assert len(quality.score(odd_docs, model).collect()) == odd_docs.count()
    assert quality.score(no_docs, model).collect() == []
    blank = quality.train(odd_docs, labels.limit(0))
    assert {r.score for r in quality.score(odd_docs, blank).collect()} == {0.5}


def test_scores_are_the_sum_of_table_entries():
    """``Model.score`` against a plain loop over the tables."""
    rng = np.random.default_rng(4)
    values = np.round(rng.normal(size=(400, 5)), 1)
    model = quality.fit(values, (values[:, 0] * values[:, 1] + values[:, 2] > 0).astype(int))
    assert model.pairs and any(t.any() for t in model.tables)
    for row, got in zip(values, model.score(values)):
        total, at = model.intercept, []
        for x, edges in zip(row, model.edges):
            at.append(sum(bool(e <= x) for e in edges))
        for k, table in zip(at, model.tables):
            total += table[k]
        for i, j, table in model.pairs:
            total += table[at[i], at[j]]
        assert abs(1 / (1 + math.exp(-total)) - got) < 1e-12


def _worth(g, h):
    return sum(g) ** 2 / (sum(h) + quality.SHRINK)


def test_trees_take_the_best_of_all_splits(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(quality, "LEAST", 3)
    for _ in range(60):
        w = int(rng.integers(1, 9))
        g, h, n = rng.normal(size=w), rng.random(w), rng.integers(0, 6, w).astype(float)
        leaves, total = [(0, w)], 0.0
        while len(leaves) < quality.LEAVES:
            options = [(_worth(g[lo:c], h[lo:c]) + _worth(g[c:hi], h[c:hi]) - _worth(g[lo:hi], h[lo:hi]), lo, c, hi)
                       for lo, hi in leaves for c in range(lo + 1, hi) if n[lo:c].sum() >= 3 and n[c:hi].sum() >= 3]
            if not options or max(options)[0] <= 1e-9:
                break
            gain, lo, c, hi = max(options)
            leaves.remove((lo, hi))
            leaves += [(lo, c), (c, hi)]
            total += gain
        want = np.zeros(w)
        for lo, hi in leaves:
            want[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + quality.SHRINK)
        got, gain = quality._tree(g, h, n)
        np.testing.assert_allclose(got, want, atol=1e-9)
        assert abs(gain - total) < 1e-9


def test_pair_trees_take_the_best_of_all_crossings(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(quality, "LEAST", 2)
    for _ in range(40):
        a, b = rng.integers(1, 6, 2)
        g, h, n = rng.normal(size=(a, b)), rng.random((a, b)), rng.integers(0, 3, (a, b)).astype(float)

        def parts(x, i, j):
            return x[:i, :j], x[:i, j:], x[i:, :j], x[i:, j:]
        options = [(sum(_worth(p.ravel(), q.ravel()) for p, q in zip(parts(g, i, j), parts(h, i, j))), i, j)
                   for i in range(1, a) for j in range(1, b) if min(p.sum() for p in parts(n, i, j)) >= 2]
        got, gain = quality._cross(g, h, n)
        if not options:
            assert not got.any() and gain == 0
            continue
        best, i, j = max(options)
        want = np.empty((a, b))
        for at, p, q in zip(((slice(0, i), slice(0, j)), (slice(0, i), slice(j, b)), (slice(i, a), slice(0, j)), (slice(i, a), slice(j, b))),
                            parts(g, i, j), parts(h, i, j)):
            want[at] = p.sum() / (q.sum() + quality.SHRINK)
        np.testing.assert_allclose(got, want, atol=1e-9)
        assert abs(gain - (best - _worth(g.ravel(), h.ravel()))) < 1e-9
