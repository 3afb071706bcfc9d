"""Bounded training sample of labelled rows, for the two text classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_bucket(doc_id, n: int) -> F.Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, bound: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord, label, text) of at most about ``bound`` labelled ids outside fold 0:
    those with the smallest id hash, so the choice depends on nothing else.  Only
    ids and labels are ordered; the chosen ids, at most ``bound``, are broadcast
    to the texts.  Rows without an id or a 0/1 label are left out."""
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")) \
        .where(F.col("_id").isNotNull() & F.col("label").isin(0, 1)) \
        .where(id_bucket("_id", folds) != 0) \
        .groupBy("_id").agg(F.max("label").alias("label")) \
        .withColumn("ord", F.xxhash64("_id")).orderBy("ord", "_id").limit(bound)
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .join(F.broadcast(chosen), "_id").select("ord", "label", "text")
