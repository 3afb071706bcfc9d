"""Forecast edge series, parameters, names, ordering, bins."""
import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from regiopanel.functions.names import normalize_name
from regiopanel.functions.ordering import global_row_number
from regiopanel.operators import forecast as FC
from regiopanel.operators import overview as OV
from regiopanel.sources import params as P
from tests.seed import seed_store


def _series(spark, g, values, start=dt.date(2020, 1, 1), skip=None):
    rows, m = [], 0
    for i, v in enumerate(values):
        if skip is not None and i == skip:
            m += 1
        y, mo = divmod(start.month - 1 + m, 12)
        rows.append((g, dt.date(start.year + y, mo + 1, 1), D(str(v))))
        m += 1
    return rows


def _visitors(spark, rows):
    return spark.createDataFrame(rows, "governorate_id int, month_index date, total_visitors decimal(14,2)")


def test_forecast_edge_series(spark):
    rows = (_series(spark, 1, [100] * 12) + _series(spark, 2, [100] * 13)
            + _series(spark, 3, [0] * 12 + [50] * 12))
    v = _visitors(spark, rows)
    trend = {(r["governorate_id"], r["forecast_month"]): r for r in FC.forecast(v, 12, "seasonal_trend_v2").collect()}
    naive = {(r["governorate_id"], r["forecast_month"]): r for r in FC.forecast(v, 12, "seasonal_naive").collect()}
    bt = {r["governorate_id"]: r for r in FC.backtest(v, "seasonal_trend_v2").collect()}
    assert 1 not in bt and not any(k[0] == 1 for k in trend)          # < 13 rows skipped
    assert bt[2]["mape"] == D("0.0000") and bt[2]["reliability_label"] == "Low"
    r = trend[(2, dt.date(2021, 2, 1))]
    assert (r["forecast_value"], r["lower_bound"], r["upper_bound"]) == (D("100.00"), D("100.00"), D("100.00"))
    r = trend[(3, dt.date(2022, 1, 1))]
    assert (r["forecast_value"], r["lower_bound"], r["upper_bound"]) == (D("51.50"), D("46.38"), D("56.62"))
    r = naive[(3, dt.date(2022, 1, 1))]
    assert (r["forecast_value"], r["lower_bound"], r["upper_bound"]) == (D("50.00"), D("44.88"), D("55.12"))
    assert (bt[3]["mae"], bt[3]["rmse"], bt[3]["mape"]) == (D("50.0000"), D("50.0000"), D("100.0000"))
    assert bt[3]["reliability_label"] == "Low"


def test_positional_lag_and_horizons(spark):
    v = _visitors(spark, _series(spark, 1, list(range(1, 25)), skip=5))   # 24 rows, one missing month
    rows = {r["rn"]: r for r in FC.series_rows(v, "seasonal_naive").collect()}
    assert rows[13]["prev"] == 1.0 and rows[24]["prev"] == 12.0
    f24 = sorted(FC.forecast(v, 24, "seasonal_naive").collect(), key=lambda r: r["forecast_month"])
    assert [r["forecast_value"] for r in f24[:12]] == [r["forecast_value"] for r in f24[12:]]
    assert FC.forecast(v, 0).count() == 0 and FC.backtest(v).count() == 1


def test_params_numeric_and_upsert(spark):
    base = P.seed_params(spark)
    bad = base.unionByName(spark.createDataFrame([("x", "abc", "text", None, None)], base.schema))
    m = P.resolve(bad)
    assert m["priority_weight_occupancy"] == 0.35 and "x" not in m and m["high_priority_threshold"] == 70.0
    ups = spark.createDataFrame([("high_priority_threshold", "60", None, None, 1),
                                 ("high_priority_threshold", "65", None, "new", 2),
                                 ("brand_new", "1.5", "number", "d", 3)],
                                "parameter_key string, parameter_value string, value_type string, "
                                "description string, update_seq long")
    out = {r["parameter_key"]: r for r in P.upsert_params(base, ups).collect()}
    assert out["high_priority_threshold"]["parameter_value"] == "65"
    assert out["high_priority_threshold"]["description"] == "new"
    assert out["brand_new"]["value_type"] == "number" and out["brand_new"]["updated_at"] is not None
    assert out["priority_weight_growth"]["parameter_value"] == "0.20"
    ups2 = spark.createDataFrame([("priority_weight_growth", "0.3", None, "set", 1),
                                  ("priority_weight_growth", "0.4", None, None, 2)],
                                 "parameter_key string, parameter_value string, value_type string, "
                                 "description string, update_seq long")
    g = P.upsert_params(base, ups2).where("parameter_key = 'priority_weight_growth'").collect()[0]
    assert (g["parameter_value"], g["description"]) == ("0.4", "set")   # earlier description survives


def test_name_normaliser(spark):
    df = spark.createDataFrame([("Ma'an",), ("Tafíla  Gov.",), (None,), ("ﬁeld",)], "n string")
    got = [r[0] for r in df.select(normalize_name(F.col("n"))).collect()]
    assert got == ["maan", "tafila gov", "", "field"]


def test_global_row_number(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = global_row_number(df, [F.col("k").desc()], "rn").collect()
    assert sorted((r["rn"], r["k"]) for r in got) == [(i + 1, 4999 - i) for i in range(5000)]


def test_map_dataset_bins_and_sites(spark):
    st = seed_store(spark)
    from regiopanel.plans import jobs as PL
    dv = PL.recompute(st)
    ov = OV.region_overview(st, dv)
    m = {r["feature_governorate_id"]: r for r in OV.map_dataset(st["boundaries"], ov, "priority_score").collect()}
    assert m[7]["metric_governorate_id"] == 7 and m[7]["metric_bin"] == "40–59.9"
    occ = {r["governorate_id"]: r["metric_bin"] for r in
           OV.map_dataset(st["boundaries"], ov, "latest_average_occupancy_rate")
           .select(F.col("feature_governorate_id").alias("governorate_id"), "metric_bin").collect()}
    assert occ[7] == "65% and above"
    assert OV.sites_with_coords(st["sites"]).count() == 7
    assert [r["site_name_en"] for r in OV.list_sites(st["sites"], 7).collect()] == [
        "Petra Archaeological Park", "Wadi Rum Protected Area"]


def test_geojson_sources_and_name_rule(spark):
    import json
    import os
    import tempfile

    from regiopanel.plans import jobs as PL
    from regiopanel.sources import geojson, sinks

    st = seed_store(spark)
    d = tempfile.mkdtemp(prefix="rp-geo-")
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"NAME_1": "Ma`an", "name": ""},
         "geometry": {"type": "Polygon", "coordinates": [[[35.1, 30.8], [36.1, 30.8], [36.1, 29.8], [35.1, 30.8]]]}},
        {"type": "Feature", "properties": {"name": "Nowhere"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]}}]}
    with open(os.path.join(d, "b.json"), "w") as f:
        json.dump(fc, f)
    b = geojson.read_feature_collection(spark, os.path.join(d, "b.json"))
    ov = OV.region_overview(st, PL.recompute(st))
    m = {r["feature_name"]: r for r in OV.map_dataset(b, ov, "priority_score", geojson.feature_name(b)).collect()}
    assert m["Ma`an"]["metric_governorate_id"] == 7 and m["Nowhere"]["metric_bin"] == "No data"
    sinks.write_geojson_seq(st["boundaries"], os.path.join(d, "lines"))
    lines = geojson.read_feature_lines(spark, os.path.join(d, "lines"))
    got = {r["governorate_id"]: r["boundary_coords"] for r in lines.collect()}
    assert len(got) == 12 and got[1][0][0][0] == [35.8, 31.8]
    k = OV.kpis({k: v for k, v in st.items() if k != "params"}, PL.recompute(st)["scores"]).collect()[0]
    assert k["high_priority_zones"] == 0


def test_global_row_number_with_null_and_tied_keys(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 3)) for i in range(1, 401)]
    df = spark.createDataFrame(rows, "g int, score double").repartition(5)
    got = global_row_number(df, [F.col("score").desc_nulls_last(), F.col("g").asc()], "rank").collect()
    expect = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r["g"] for r in sorted(got, key=lambda r: r["rank"])] == [r[0] for r in expect]
    assert sorted(r["rank"] for r in got) == list(range(1, 401))


def test_reliability_label_thresholds(spark):
    from regiopanel.functions import columns as C
    rows = [(24, 12.0), (24, 12.01), (18, 20.0), (23, 20.01), (17, 1.0), (30, None)]
    df = spark.createDataFrame(rows, "n int, mape double")
    got = [r[0] for r in df.select(C.reliability("n", "mape")).collect()]
    assert got == ["High", "Moderate", "Moderate", "Low", "Low", "Low"]
