"""Headline-query benchmark.

Runs each headline query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "headline_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
Each query: one warm-up, then the median of 3 timed runs.  Every run
re-executes the whole plan from the Parquet tables (outputs are forced with
the ``noop`` sink or a collect of the small result).  Rows in/out, cores,
Spark version and the relevant settings are recorded alongside (untimed).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from regiopanel import schemas as S  # noqa: E402
from regiopanel.operators import overview as OV  # noqa: E402
from regiopanel.plans import jobs as PL  # noqa: E402
from regiopanel.session import get_session  # noqa: E402
from regiopanel.sources import ingest as ING  # noqa: E402
from regiopanel.sources import proxy as PX  # noqa: E402
from regiopanel.sources import standin as STAND  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
N_SCENARIOS_PER_REGION = 1000


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def q_panel_build(spark):
    st = PX.panel_store(spark, SF_DIR)
    noop(st["visitors"])
    rb, occ = PX.rooms_beds_and_occupancy(PX.read_table(spark, SF_DIR, "lineitem"),
                                          PX.read_table(spark, SF_DIR, "supplier"))
    out = rb.join(occ, [S.G, S.M], "left")
    noop(out)
    return out


def q_recompute(spark):
    st = PX.panel_store(spark, SF_DIR)
    d = PL.recompute(st, persist=True)
    for name in ("indicators", "classification", "scores"):
        noop(d[name])
    return d["scores"]


def q_forecast_backtest(spark):
    st = PX.panel_store(spark, SF_DIR)
    run = PL.run_forecast(st, 1, 12, "seasonal_trend_v2", persist=True)
    noop(run["forecast"])
    noop(run["backtest"])
    return run["forecast"]


def q_scenario_eval(spark):
    st = PX.panel_store(spark, SF_DIR)
    st = PL.with_forecast_run(st, PL.run_forecast(st, 1, 12, "seasonal_trend_v2"))
    dv = PL.recompute(st)
    last = st["visitors"].groupBy(S.G).agg(F.max(S.M).alias("last"))
    k = F.explode(F.sequence(F.lit(1), F.lit(N_SCENARIOS_PER_REGION))).alias("k")
    sc = last.select(S.G, "last", k).select(
        (F.col(S.G).cast("long") * 100000 + F.col("k")).alias("scenario_run_id"), S.G,
        F.add_months("last", (F.col("k") % 12 + 1).cast("int")).alias("target_month"),
        (F.col("k") * 10).cast("int").alias("additional_beds"), F.lit(0).alias("additional_rooms"),
        (F.col("k") % 7 / 100).cast("decimal(10,4)").alias("induced_demand_ratio"),
        F.lit(None).cast("long").alias("based_on_model_run_id"))
    out = PL.run_scenarios(st, dv, sc)["scenario_result"]
    noop(out)
    return out


def q_import_quarantine(spark):
    raw = STAND.visitors_import_rows(PX.read_table(spark, SF_DIR, "orders"))
    r = ING.import_rows(raw, "visitors_monthly", persist=True)
    noop(r["loaded"])
    noop(r["errors"])
    r["summary"].collect()
    return r["typed"]


def q_forecast_many_series(spark):
    """One series per part (20k at sf0.1) from lineitem: monthly sums, seasonal-trend
    forecast and backtest of every series in one job."""
    series = PX.part_series(PX.read_table(spark, SF_DIR, "lineitem"))
    run = PL.run_forecast({"visitors": series}, 1, 12, "seasonal_trend_v2", persist=True)
    noop(run["forecast"])
    noop(run["backtest"])
    return run["forecast"]


_CSV = {}


def _import_csv_file(spark):
    """Setup (untimed): a visitors-shaped CSV derived from lineitem, with the
    same hostile-record rule as the orders stand-in, written once."""
    if "path" not in _CSV:
        li = PX.read_table(spark, SF_DIR, "lineitem").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o_orderkey"),
            F.col("l_suppkey").alias("o_custkey"), F.col("l_extendedprice").alias("o_totalprice"),
            F.col("l_shipdate").alias("o_orderdate"))
        path = tempfile.mkdtemp(prefix="regiopanel-bench-") + "/visitors_csv"
        STAND.visitors_import_rows(li).drop("_row").write.option("header", True).csv(path)
        _CSV["path"] = path
    return _CSV["path"]


def q_import_csv(spark):
    r = ING.import_csv(spark, _import_csv_file(spark), "visitors_monthly")
    noop(r["loaded"])
    noop(r["errors"])
    r["summary"].collect()
    return r["typed"]


def q_region_overview(spark):
    st = PX.panel_store(spark, SF_DIR)
    st = PL.with_forecast_run(st, PL.run_forecast(st, 1, 12, "seasonal_trend_v2"))
    out = OV.region_overview(st, PL.recompute(st))
    out.collect()
    return out


def q_kpis(spark):
    st = PX.panel_store(spark, SF_DIR)
    out = OV.kpis(st, PL.recompute(st)["scores"])
    out.collect()
    return out


QUERIES = {
    "panel_build": q_panel_build,
    "recompute": q_recompute,
    "forecast_backtest": q_forecast_backtest,
    "scenario_eval_25k": q_scenario_eval,
    "import_quarantine": q_import_quarantine,
    "forecast_part_series": q_forecast_many_series,
    "import_csv_lineitem": q_import_csv,
    "region_overview": q_region_overview,
    "kpis": q_kpis,
}


def main():
    spark = get_session(f"local[{CPUS}]", CPUS, app_name="regiopanel-bench",
                        extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    out, rows_out = {}, {}
    for name, fn in QUERIES.items():
        spark.catalog.clearCache()
        fn(spark)   # warm-up (JIT, file listing)
        times = []
        for _ in range(3):
            spark.catalog.clearCache()   # every timed run rebuilds the panel from Parquet
            t0 = time.perf_counter()
            result = fn(spark)
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
        rows_out[name] = result.count()   # untimed
    rows_in = {t: PX.read_table(spark, SF_DIR, t).count() for t in ("orders", "lineitem", "customer", "supplier")}
    conf = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
                                           "spark.sql.adaptive.skewJoin.enabled",
                                           "spark.sql.autoBroadcastJoinThreshold")}
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(m.group(1)) if m else SF_DIR, "cpus": CPUS,
                      "spark": spark.version, "rows_in": rows_in, "rows_out": rows_out, "conf": conf}))


if __name__ == "__main__":
    main()
