import zlib
from collections import defaultdict

import pytest

from yieldlens.llm import shards

SF = "/root/testdata/sf0.001"


def check(df, n):
    docs = sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                  for r in df.select("doc_id", "text").collect())
    got = shards.shard_documents(df, n).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == docs
    slots, held = defaultdict(list), defaultdict(int)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < n and r.grown_shard is None
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest, mean = max((r.size for r in got), default=0), sum(held.values()) / n
    assert all(abs(held[k] - mean) <= largest for k in range(n))
    return got


def test_documents(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"), 8)
    where = defaultdict(list)
    for r in got:
        where[r.text_crc32, r.size].append(r.shard)
    assert all(max(s) - min(s) <= 1 for s in where.values())            # equal texts lie together


@pytest.mark.parametrize("same_id", [False, True])
def test_a_third_of_the_rows_is_one_text(spark, same_id):
    rows = [(7 if same_id else k, "copied text") for k in range(1000)] + [(5000 + k, f"text {k}") for k in range(2000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 40)


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, 3)
    check(odd_docs, 40)
    assert shards.shard_documents(no_docs).collect() == []


def test_no_python_in_the_plan(spark):
    plan = shards.shard_documents(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
