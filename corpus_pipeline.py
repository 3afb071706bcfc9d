"""Corpus pipeline: from ``documents`` to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns
of ``documents``; the last returns the packed pieces.  ``run`` writes each stage's
result as Parquet to the shared folder and reads it back as the next one's input,
so a lost executor costs tasks of one stage only.

Stages: drop documents that the quality classifier rejects; keep the row with the
largest id of equal texts; keep one document of each near-duplicate group (five-word
shingles, Jaccard 0.8 or more; the smallest id stays); drop documents that leak
benchmark items; cut and pack what is left into sequences of 2048 tokens.

Stages work on rows, not on ids: rows with null or repeated ids are decided each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regiopanel.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from regiopanel.llm.common import load, stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, load(spark, sf_dir, "labels"), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs, n=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

# The classifier, the tokenizer and the packing can't be expressed in SQL;
# tests/llm/test_pipeline.py holds the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
