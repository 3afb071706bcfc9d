"""Stand-in import input built from the driver's ``orders`` table.

The driver ships no CSV uploads, so a visitors import file is stood in by one
all-string record per order, in the same shape the CSV scan produces
(header columns as strings + record ordinal ``_row``).  Some records are
made hostile (bad id, bad month, blank or negative measure, unpadded month)
by a rule on the order key.  This module only *builds input*; the import job
(``sources.ingest``) knows nothing about how the rows were made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visitors_import_rows(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    gid = F.when(k % 97 == 5, F.concat(F.lit("x"), F.col("o_custkey").cast("string"))) \
        .otherwise(F.col("o_custkey").cast("string"))
    month = (F.when(k % 89 == 3, F.lit("bad-month"))
             .when(k % 83 == 1, F.date_format(day, "yyyy-M-1"))
             .otherwise(F.date_format(day, "yyyy-MM-01")))
    price = F.format_string("%.2f", F.col("o_totalprice"))
    value = (F.when(k % 79 == 2, F.lit(""))
             .when(k % 73 == 4, F.concat(F.lit("-"), price))
             .otherwise(price))
    return orders.select((k + 2).alias("_row"), gid.alias("governorate_id"), month.alias("month_index"),
                         value.alias("total_visitors"))
