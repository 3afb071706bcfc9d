"""Distributed positional numbering.

``global_row_number`` gives a dense 1..N position in a total order without a
window over the whole frame (which would put every row into one task): rows
are range-partitioned and sorted, the sorted frame (with partition id and
in-partition position) is checkpointed so both branches below see identical
partitions, then per-partition counts (one row per partition) are turned into
offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiopanel.session import materialize


def global_row_number(df: DataFrame, order_cols: list, name: str = "row_number") -> DataFrame:
    s = materialize(df.orderBy(*order_cols)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_min"))
    # One row per partition: a window over this small frame is cheap.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    return (s.join(F.broadcast(offsets.select("_pid", "_off", "_min")), "_pid")
            .withColumn(name, F.col("_off") + F.col("_mid") - F.col("_min") + 1)
            .drop("_pid", "_mid", "_off", "_min"))
