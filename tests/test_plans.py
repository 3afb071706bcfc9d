"""Plan-shape checks for the scale properties claimed in README / PLANS.md."""
import re

from regiopanel.operators import forecast as FC
from regiopanel.plans import registry as R
from regiopanel.sources import proxy as PX
from tests.plan_report import counts, final_nodes, formatted

SF = "/root/testdata/sf0.01"


def test_forecast_windows_share_one_exchange(spark):
    spark.catalog.clearCache()
    st = PX.panel_store(spark, SF)
    top, cached, _ = final_nodes(formatted(FC.forecast(st["visitors"], 12, "seasonal_trend_v2")))
    c = counts(top)
    assert c["shuffle Exchange"] == 1 and c["Window"] == 4 and c["SortMergeJoin"] == 0


def test_proxy_scans_are_pruned(spark):
    st = PX.panel_store(spark, SF)
    text = formatted(st["rooms_beds"])
    schema = re.search(r"lineitem.parquet\]\n(?:PushedFilters: .*\n)?ReadSchema: (struct<[^>]*>)", text).group(1)
    assert "l_extendedprice" not in schema and "l_returnflag" not in schema and "l_quantity" in schema


def test_latest_month_is_a_scalar_subquery(spark):
    text = formatted(R.q_kpis(spark, SF))
    top, _, n_sub = final_nodes(text)
    assert n_sub >= 1 and "Subquery" in text
    # Only 1-row attachments may be nested-loop joins (threshold parameter, newest run id).
    assert counts(top)["BroadcastNestedLoopJoin"] <= 2


SKEW_CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k"}


def test_hot_supplier_is_split_and_exact(spark):
    """A third of lineitem on one supplier: with the dimension too large to
    broadcast (forced here), the join is a sort-merge join whose hot partition
    AQE splits; results equal an independent DuckDB computation."""
    import duckdb
    from pyspark.sql import functions as F

    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    spark.catalog.clearCache()
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    try:
        # Input construction: several input partitions (as any large input has),
        # a third of the rows re-keyed to supplier 7.
        li = PX.read_table(spark, SF, "lineitem").repartition(8)
        hot = li.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(7).cast("long"))
                            .otherwise(F.col("l_suppkey")))
        rb, _ = PX.rooms_beds_and_occupancy(hot, PX.read_table(spark, SF, "supplier"))
        text = formatted(rb)
        got = sorted((r[0], r[1], float(r[2]), float(r[3])) for r in rb.collect())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        spark.catalog.clearCache()
    assert "SortMergeJoin(skew=true)" in text
    want = duckdb.sql(f"""
        SELECT CAST(s.s_nationkey AS INTEGER), CAST(date_trunc('month', l.l_shipdate) AS DATE),
               CAST(count(*) AS DOUBLE), CAST(sum(l.l_quantity) AS DOUBLE)
        FROM read_parquet('{SF}/lineitem.parquet') l
        JOIN read_parquet('{SF}/supplier.parquet') s
          ON s.s_suppkey = CASE WHEN l.l_orderkey % 3 = 0 THEN 7 ELSE l.l_suppkey END
        GROUP BY 1, 2""").fetchall()
    assert got == sorted(want)
