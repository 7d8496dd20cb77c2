"""Training corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark
decontamination, packing. Each stage takes (spark, docs, sf_dir), works on all that its
predecessor kept, and but for the last returns the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from yieldlens.llm import decontaminate, line_dedup, packing, quality, simhash
from yieldlens.llm.common import stored
from yieldlens.llm.queries import WORD_BPE, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (10), trained on their labels, does not reject."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of smaller id holds (8)."""
    return line_dedup.without_copied_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-equal fingerprints (1)."""
    return simhash.one_per_class(docs, shingle=3, max_bits=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (3)."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences (2)."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("quality classifier", quality_filter), ("line dedup", drop_copied_lines),
          ("simhash near-dedup", drop_near_copies), ("benchmark decontamination", drop_benchmark_leaks),
          ("packing", pack)]

ORACLE_SQL = None        # tested against a brute-force version in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
