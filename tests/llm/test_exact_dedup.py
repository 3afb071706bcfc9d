"""Exact dedup: SQL over documents, levels, ties, nulls."""
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from regiopanel.llm import common, exact_dedup

SF = "/root/testdata/sf0.01"


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = E.queries()["op10_exact_dedup"](spark, SF)
    cur = con.execute(E.oracle_sql()["op10_exact_dedup"])
    assert [d[0] for d in cur.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_hot_group_over_many_runs(spark, keep, best):
    rows = [(i, "copy" if i % 3 else f"t{i % 40}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(23)
    got = exact_dedup.exact_dedup(df, keep=keep, fan_in=2).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t, []).append(i)
    text = {i: t for i, t, _ in rows}
    for r in got:
        g = groups[text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (best(g), len(g), r.doc_id == best(g))


def test_nulls_ties_repeats(spark):
    rows = [(None, None, 1), (None, "", 2), (3, "", 3), (3, "", 4), (None, "n", 5), (None, "n", 6), (8, "A", 7), (9, "a", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_number_ int")
    got = sorted(map(str, map(tuple, exact_dedup.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept").collect())))
    assert got == sorted(map(str, [(None, 3, 4, False)] * 2 + [(3, 3, 4, True), (3, 3, 4, False)]
                             + [(None, None, 2, True), (None, None, 2, False), (8, 8, 1, True), (9, 9, 1, True)]))
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns and out.count() == 4
    assert out.where("doc_id is null").count() == 1
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0


def test_no_python_in_the_plan(spark):
    df = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert "Python" not in df._jdf.queryExecution().toString() and "Pandas" not in df._jdf.queryExecution().toString()


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1001), (1002, 1001), (7, 7)] + [(5000, 5000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain, "a long, b long").withColumn("x", F.lit(1))
    got = dict(map(tuple, common.connected_components(edges).collect()))
    assert got == {i: 0 for i in range(61)} | {1000: 1000, 1001: 1000, 1002: 1000} | {5000 + i: 5000 for i in range(50)}
    assert common.connected_components(edges.where("false")).count() == 0
