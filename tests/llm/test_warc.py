"""Round trips through real archives against hashlib."""
import base64
import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from regiopanel.llm import warc
from regiopanel.llm.common import fresh_folder

SF = "/root/testdata/sf0.01"


def expected(rows, least=0):
    first = {}
    for pid, html in rows:
        if pid is not None:
            key = html or ""
            first[key] = min(pid, first.get(key, pid))
    out = []
    for pid, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        lead = first.get(html or "")
        revisit = len(data) >= least and lead is not None and pid != lead
        out.append((pid, len(data), digest, "revisit" if revisit else "response", lead if revisit else None))
    return out


def key(r):
    return [(x is None, x) for x in r]


def result(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=key)


def test_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    assert result(E.queries()["op4_warc"](spark, SF)) == sorted(expected(pages), key=key)


ROWS = [(9007199254740993 + i, "<p>same</p>") for i in range(40)] + [(3, None), (4, ""), (None, "é" * 50_000), (None, "<p>same</p>"),
                                                                       (-5, "x\r\n\r\nWARC/1.1\r\n"), (7, "lone")]


@pytest.mark.parametrize("least", [0, 5, 12])
def test_copies_nulls_and_rolling(spark, least):
    df = spark.createDataFrame([(p, f"http://h/{p}\r\nX: y", h, 1) for p, h in ROWS], "page_id long, url string, html string, digest int")
    assert result(warc.archive_round_trip(df.repartition(5), least_bytes=least, file_bytes=600, shard_bytes=2000)) \
        == sorted(expected(ROWS, least), key=key)


def test_same_input_same_files(spark):
    df = spark.createDataFrame([(p, f"http://h/{p}", h) for p, h in ROWS], "page_id long, url string, html string")
    a, b = (sorted(map(tuple, warc.write_archive(x, fresh_folder(spark, "w"), file_bytes=900, shard_bytes=3000).collect()))
            for x in (df, df.repartition(7)))
    assert a == b and len(a) > 3 and sum(r[2] for r in a) == len(ROWS)


def test_same_row_twice(spark):
    df = spark.createDataFrame([(1, "u", "h")] * 3, "page_id long, url string, html string")
    assert [r[3:] for r in result(warc.archive_round_trip(df))] == [("response", None), ("revisit", 1), ("revisit", 1)]


def test_payloads_come_back_and_damage_is_found(spark):
    df = spark.createDataFrame([(1, "u", "héllo"), (2, None, "b\0c")], "page_id long, url string, html string")
    folder = fresh_folder(spark, "w")
    manifest = warc.write_archive(df, folder)
    assert {r.page_id: (r.payload, r.url) for r in warc.read_archive(folder, manifest).collect()} == {1: ("héllo", "u"), 2: ("b\0c", "")}
    with pytest.raises(Exception, match="differs from its manifest"):
        warc.read_archive(folder, manifest.withColumn("sha1", F.lit("0"))).collect()


def test_a_lost_file_or_record_is_found(spark):
    import os
    df = spark.createDataFrame([(i, "u", f"page {i}" * 30) for i in range(40)], "page_id long, url string, html string")
    folder = fresh_folder(spark, "w")
    manifest = warc.write_archive(df, folder, file_bytes=1500, shard_bytes=9000)
    files = sorted(r.file for r in manifest.collect())
    assert len(files) > 3 and warc.read_archive(folder, manifest).count() == 40
    with pytest.raises(Exception, match="records, its manifest entry"):
        warc.read_archive(folder, manifest.withColumn("records", F.col("records") + 1)).collect()
    os.remove(f"{folder.removeprefix('file:')}/{files[1]}")
    with pytest.raises(Exception, match="of the manifest is missing"):
        warc.read_archive(folder, manifest).collect()


def test_shards_follow_the_ids(spark):
    """Clustered ids, outliers at both ends of the range, an id that repeats."""
    ids = [-(1 << 63), (1 << 63) - 1] + [10**12 + i for i in range(300)] + [5] * 40
    df = spark.createDataFrame([(i, "u", "x" * 400) for i in ids], "page_id long, url string, html string")
    manifest = warc.write_archive(df.repartition(4), fresh_folder(spark, "w"), shard_bytes=20_000).collect()
    records = {}
    for r in manifest:
        records[r.shard] = records.get(r.shard, 0) + r.records
    assert sum(records.values()) == len(ids) and len(records) >= 12
    assert max(records.values()) <= 41 + 20  # the id that repeats is one slice


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(df).count() == 0
