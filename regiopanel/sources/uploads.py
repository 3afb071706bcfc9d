"""CSV uploads built from the driver's tables (input only).

The driver ships no CSV files, so these write some: CSV text in the shared folder,
range-sorted, with free-text columns full of commas, quotes and line breaks, and with
some hostile fields by a rule on the row's key.  Odd rows go to files with another
column order.  The import job (``sources.ingest``) only sees the files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel.session import ensure_checkpoint_dir
from regiopanel.sources.sinks import write_csv

LINE_KEY = ["l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_discount"]


def new_folder(df: DataFrame, name: str) -> str:
    return f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def split_bytes_for(df: DataFrame, text_col: str, least: int = 1 << 16, most: int = 128 << 20) -> int:
    """About 64 splits, of 64 KB to 128 MB each: a small upload has several as well."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(least, min(most, total // 64))


def split_bytes_of(spark, path: str, least: int = 1 << 16, most: int = 128 << 20) -> int:
    """The same by the size of the files of a folder or a glob."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    total = sum(fs.getContentSummary(s.getPath()).getLength() for s in fs.globStatus(p))
    return max(least, min(most, total // 64))


def documents_upload(documents: DataFrame) -> str:
    """One record per document: doc_id, text, lang, in the order of doc_id."""
    folder = new_folder(documents, "upload-documents")
    write_csv(documents.select("doc_id", "text", "lang").orderBy("doc_id"), folder)
    return folder


def _line_fields(lineitem: DataFrame) -> DataFrame:
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    day = F.col("l_shipdate").cast("date")
    return lineitem.withColumns({
        "k": k, "odd": F.col("l_orderkey") % 2,
        "governorate_id": F.when(k % 97 == 5, F.concat(F.lit("x"), F.col("l_suppkey").cast("string")))
        .otherwise((F.col("l_suppkey") % 50).cast("string")),
        "month_index": F.when(k % 89 == 3, F.lit("bad-month")).when(k % 83 == 1, F.date_format(day, "yyyy-M-1"))
        .otherwise(F.date_format(day, "yyyy-MM-01")),
        "remarks": F.when(k % 3 == 0, F.concat(F.lit('shipped "'), F.col("l_returnflag"), F.lit('",\n'), F.date_format(day, "yyyy-MM-dd")))
        .when(k % 3 == 1, F.concat(F.lit("line "), k.cast("string"), F.lit(", as ordered")))
        .otherwise(F.concat(F.lit("\n"), F.col("l_linestatus"), F.lit("\r\n\n")))})


def _two_orders(rows: DataFrame, name: str, columns: list[str], turned: list[str]) -> str:
    """Files in two folders below one: even order keys with ``columns``, odd ones with
    ``turned``; read both as ``folder/*``."""
    folder = new_folder(rows, name)
    for odd, cols in ((0, columns), (1, turned)):
        write_csv(rows.where(F.col("odd") == odd).orderBy(*LINE_KEY).select(*cols), f"{folder}/{odd}")
    return f"{folder}/*"


def rooms_beds_upload(lineitem: DataFrame) -> str:
    """One record per order line: rooms are its line number, beds its quantity."""
    k, rooms = F.col("k"), F.col("l_linenumber").cast("string")
    rows = _line_fields(lineitem).withColumns({
        "total_rooms": F.when(k % 79 == 2, F.lit("")).when(k % 73 == 4, F.concat(F.lit("-"), rooms)).otherwise(rooms),
        "total_beds": F.col("l_quantity").cast("int").cast("string")})
    return _two_orders(rows, "upload-rooms-beds", ["governorate_id", "month_index", "total_rooms", "total_beds", "remarks"],
                       ["remarks", "total_beds", "month_index", "total_rooms", "governorate_id"])


def occupancy_upload(lineitem: DataFrame) -> str:
    """One record per order line: the rate is its discount."""
    k, rate = F.col("k"), F.format_string("%.2f", F.col("l_discount"))
    rows = _line_fields(lineitem).withColumn(
        "average_occupancy_rate", F.when(k % 79 == 2, F.lit("n/a")).when(k % 73 == 4, F.concat(F.lit(" "), rate, F.lit(" "))).otherwise(rate))
    return _two_orders(rows, "upload-occupancy", ["governorate_id", "month_index", "average_occupancy_rate", "remarks"],
                       ["average_occupancy_rate", "remarks", "governorate_id", "month_index"])


def visitors_upload(orders: DataFrame) -> str:
    """The visitors stand-in rows of ``sources.standin`` as CSV text, by order key."""
    from regiopanel.sources.standin import visitors_import_rows

    folder = new_folder(orders, "upload-visitors")
    rows = visitors_import_rows(orders).withColumn("note", F.concat(F.lit('order "'), F.col("_row").cast("string"), F.lit('"\nby mail, ""')))
    write_csv(rows.orderBy("_row").select("note", "governorate_id", "month_index", "total_visitors"), folder)
    return folder
