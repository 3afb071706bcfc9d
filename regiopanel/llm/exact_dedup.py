"""Exact dedup by a tree merge of sorted digest runs (native DataFrame code).

Every scan partition becomes one run: (digest, id) rows sorted by digest and
written to the shared folder, so texts are read once and never shuffled.  Runs
are then merged in rounds of ``fan_in`` runs: in each round a run joins the run with
the lowest number of its block, and equal digests merge into one entry that keeps the
winning identifier and the number of rows.  Entries of a block stay spread over all
tasks by digest, so the last round, with one run left, is as parallel as the first,
and a digest held by a third of all rows costs at most one entry for each run.

What is left of the dealt method: runs, rounds of a tree, the winning identifier kept at
every level.  The merge itself is Spark's hash aggregation on (run, digest); it does not
read the runs' order, which serves compression and row-group statistics only.

Two texts count as equal when SHA-256, xxhash64 and byte length all agree, at
every level; a collision of one of them would keep its texts apart.  Bytes are not
compared.

Defined cases: a null text equals the empty text; a null id loses against every
other id; of several rows with the winning id exactly one is kept; an empty
table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, fresh_name, numbered_rows, small_enough, stage

_KEY = ["sha", "fp", "n_bytes"]
_LONG_MIN, _LONG_MAX = -(1 << 63), (1 << 63) - 1


def digest_runs(docs: DataFrame, id_col: str, text_col: str, keep: str, row: F.Column) -> DataFrame:
    """One sorted run of digests for each partition of the scan.  ``ord`` is the
    id with nulls moved to the losing end."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lost = _LONG_MIN if keep == "largest" else _LONG_MAX
    doc_id = F.col(id_col).cast("long")
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(lost)).alias("ord"), row.alias("row"),
        F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("fp"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.spark_partition_id().cast("long").alias("run"),
    ).sortWithinPartitions("sha", "ord")


def merge_runs(runs: DataFrame, n_runs: int, keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """All runs merged to one entry per text: (key, keep_ord, keep_row, size)."""
    best, best_by = (F.max, F.max_by) if keep == "largest" else (F.min, F.min_by)
    level = runs.groupBy("run", *_KEY).agg(
        best("ord").alias("keep_ord"), best_by("row", "ord").alias("keep_row"), F.count(F.lit(1)).alias("size"))
    while n_runs > 1:
        level = level.groupBy(F.floor(F.col("run") / fan_in).alias("run"), *_KEY).agg(
            best("keep_ord").alias("best_ord"), best_by("keep_row", "keep_ord").alias("keep_row"), F.sum("size").alias("size"),
        ).withColumnRenamed("best_ord", "keep_ord")
        n_runs = -(-n_runs // fan_in)
    return level.drop("run")


def _decided(runs: DataFrame, keep: str, fan_in: int) -> DataFrame:
    n_runs = (runs.agg(F.max("run")).first()[0] or 0) + 1
    merged = merge_runs(runs, n_runs, keep, fan_in)
    return runs.join(merged, _KEY).withColumn("kept", F.col("row") == F.col("keep_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    runs = stage(digest_runs(docs, id_col, text_col, keep, F.monotonically_increasing_id()), "digest-runs")
    lost = _LONG_MIN if keep == "largest" else _LONG_MAX
    return _decided(runs, keep, fan_in).select(
        "doc_id", F.nullif("keep_ord", F.lit(lost)).alias("keep_id"), F.col("size").alias("group_size"),
        "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.  Ids may be null or
    repeat, so rows go by their number (``common.numbered_rows``)."""
    row = fresh_name(docs, "row_number_")
    numbered = numbered_rows(docs, row)
    runs = stage(digest_runs(numbered, id_col, text_col, keep, F.col(row)), "digest-runs")
    dropped = stage(_decided(runs, keep, fan_in).where("not kept").select(F.col("row").alias(row)), "dropped-rows")
    drop_stage(runs)
    return numbered.join(small_enough(dropped), row, "left_anti").drop(row)
