"""Golden values on the seed deployment (FIXTURES.md section 3)."""
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from regiopanel.operators import forecast as FC
from regiopanel.operators import overview as OV
from regiopanel.plans import jobs as PL

D = Decimal
LAST = dt.date(2025, 12, 1)


def test_kpis_before_and_after_forecast(seed):
    k0 = OV.kpis(seed["store0"], seed["before"]["scores"]).collect()[0]
    assert k0["latest_month"] == "2025-12-01"
    assert k0["total_visitors"] == D("1042513.56")
    assert k0["total_rooms"] == D("21285.00")
    assert k0["total_beds"] == D("44698.50")
    assert round(k0["average_occupancy_rate"], 8) == 0.65850833
    assert k0["high_priority_zones"] == 0
    k1 = OV.kpis(seed["store"], seed["after"]["scores"]).collect()[0]
    assert k1["high_priority_zones"] == 3


FC_GOLD = {  # g: avg_growth, sigma, first (v, lo, hi), last (v, lo, hi), trend (mae, rmse, mape)
    1: (0.113866090, 1003.844504, ("55390.33", "54105.41", "56675.25"), ("66913.50", "65628.58", "68198.42"),
        ("179.5474", "199.2821", "0.2908")),
    2: (0.113866090, 994.800859, ("54891.32", "53617.98", "56164.67"), ("66310.68", "65037.33", "67584.02"),
        ("177.9299", "197.4867", "0.2908")),
    7: (0.113866088, 1929.009303, ("106439.26", "103970.13", "108908.39"), ("128582.43", "126113.30", "131051.56"),
        ("345.0221", "382.9446", "0.2908")),
    12: (0.113866090, 2061.950872, ("113774.74", "111135.44", "116414.03"), ("137443.95", "134804.65", "140083.24"),
         ("368.8001", "409.3361", "0.2908")),
}
NAIVE_GOLD = {1: ("6843.1500", "6916.3868", "10.2216"), 2: ("6781.5000", "6854.0770", "10.2216"),
              7: ("13149.9450", "13290.6783", "10.2216"), 12: ("14056.2000", "14206.6322", "10.2216")}


def test_forecast_and_backtest_goldens(seed):
    st = seed["store"]
    stats = {r["governorate_id"]: r for r in
             FC.series_stats(FC.series_rows(st["visitors"], "seasonal_trend_v2")).collect()}
    fc = {(r["governorate_id"], r["forecast_month"]): r for r in st["forecast"].collect()}
    bt = {r["governorate_id"]: r for r in st["backtest"].collect()}
    assert len(fc) == 12 * 12 and len(bt) == 12
    for g, (growth, sigma, first, last, metrics) in FC_GOLD.items():
        assert stats[g]["avg_growth"] == pytest.approx(growth, abs=1e-9)
        assert stats[g]["sigma"] == pytest.approx(sigma, abs=1e-6)
        f1, f12 = fc[(g, dt.date(2026, 1, 1))], fc[(g, dt.date(2026, 12, 1))]
        assert (f1["forecast_value"], f1["lower_bound"], f1["upper_bound"]) == tuple(map(D, first))
        assert (f12["forecast_value"], f12["lower_bound"], f12["upper_bound"]) == tuple(map(D, last))
        assert (bt[g]["mae"], bt[g]["rmse"], bt[g]["mape"]) == tuple(map(D, metrics))
    assert {r["reliability_label"] for r in bt.values()} == {"High"}
    naive = {r["governorate_id"]: r for r in FC.backtest(st["visitors"], "seasonal_naive").collect()}
    for g, m in NAIVE_GOLD.items():
        assert (naive[g]["mae"], naive[g]["rmse"], naive[g]["mape"]) == tuple(map(D, m))


IND_GOLD = [  # g, vpb, occ idx, adequacy, fc idx, score before, score after, class
    (7, "31592.2167", "90.2600", "31.6534", "100.0000", "58.75", "78.75", "Under-capacity"),
    (12, "25110.6227", "71.7400", "39.8238", "92.6127", "52.27", "70.79", "Balanced"),
    (11, "24842.7284", "70.9800", "40.2532", "91.6247", "52.01", "70.33", "Balanced"),
    (10, "24544.2177", "70.1300", "40.7428", "90.5237", "51.71", "69.81", "Balanced"),
    (9, "24209.5238", "69.1700", "41.3061", "89.2893", "51.37", "69.23", "Balanced"),
    (8, "23831.6436", "68.0900", "41.9610", "87.8956", "50.99", "68.57", "Balanced"),
    (6, "22907.9365", "65.4500", "43.6530", "84.4888", "50.07", "66.97", "Balanced"),
    (5, "22335.2381", "63.8100", "44.7723", "82.3766", "49.50", "65.97", "Balanced"),
    (4, "21662.9400", "61.8900", "46.1618", "79.8970", "48.82", "64.80", "Balanced"),
    (3, "20862.5850", "59.6100", "47.9327", "76.9452", "48.03", "63.41", "Balanced"),
    (1, "17528.3613", "50.0800", "57.0504", "64.6479", "44.69", "57.62", "Balanced"),
    (2, "17149.7710", "49.0000", "58.3098", "63.2516", "44.31", "56.96", "Balanced"),
]


def _at_last(df):
    return {r["governorate_id"]: r for r in df.where(F.col("month_index") == LAST).collect()}


def test_indicators_scores_and_ranking(seed):
    ind = _at_last(seed["after"]["indicators"])
    s0 = _at_last(seed["before"]["scores"])
    s1 = _at_last(seed["after"]["scores"])
    cls = _at_last(seed["after"]["classification"])
    for g, vpb, occ, adeq, fci, before, after, klass in IND_GOLD:
        r = ind[g]
        assert r["visitors_per_1000_beds"] == D(vpb)
        assert r["occupancy_pressure_index"] == D(occ)
        assert r["capacity_adequacy_index"] == D(adeq)
        assert r["forecast_pressure_index"] == D(fci)
        assert r["growth_pressure_index"] == D("10.8108")
        assert s0[g]["priority_score"] == D(before)
        assert s1[g]["priority_score"] == D(after)
        assert s1[g]["growth_component"] == D("2.16")
        assert s1[g]["visitor_bed_component"] == D("25.00")
        assert cls[g]["capacity_classification"] == klass
    assert all(r["forecast_pressure_index"] is None for r in _at_last(seed["before"]["indicators"]).values())
    ov = OV.region_overview(seed["store"], seed["after"]).collect()
    assert [r["governorate_id"] for r in ov] == [g for g, *_ in IND_GOLD]
    ranks = {r["governorate_id"]: r["investment_rank"] for r in
             OV.region_rank(OV.region_overview(seed["store"], seed["after"])).collect()}
    assert [g for g, _ in sorted(ranks.items(), key=lambda kv: kv[1])] == [g for g, *_ in IND_GOLD]


def test_scenario_golden(spark, seed):
    sc = spark.createDataFrame(
        [(1, 2, dt.date(2026, 12, 1), 500, 200, D("0.0500"), None)],
        "scenario_run_id long, governorate_id int, target_month date, additional_beds int, additional_rooms int, "
        "induced_demand_ratio decimal(10,4), based_on_model_run_id long")
    out = PL.run_scenarios(seed["store"], seed["after"], sc)
    r = out["scenario_result"].collect()[0]
    assert (r["baseline_demand"], r["scenario_demand"], r["demand_delta"]) == (
        D("66310.68"), D("69626.21"), D("3315.53"))
    assert (r["baseline_beds"], r["scenario_beds"]) == (D("3471.30"), D("3971.30"))
    assert (r["priority_score_before"], r["priority_score_after"]) == (D("59.59"), D("58.34"))
    assert (r["visitors_per_1000_beds_before"], r["visitors_per_1000_beds_after"]) == (
        D("19102.5495"), D("17532.3481"))
    assert (r["capacity_status_before"], r["capacity_status_after"]) == ("Balanced", "Over-capacity")
    assert r["recommendation_text"].startswith("Scenario changes are modest")
    run = out["scenario_run"].collect()[0]
    assert run["based_on_model_run_id"] == 1 and run["scenario_type"] == "bed_addition"
    assert out["rejected"].count() == 0


def test_scenario_rejects_region_without_history(spark, seed):
    sc = spark.createDataFrame([(9, 99, dt.date(2026, 1, 1), 10, 0, D("0"), 0)],
                               "scenario_run_id long, governorate_id int, target_month date, additional_beds int, "
                               "additional_rooms int, induced_demand_ratio decimal(10,4), based_on_model_run_id long")
    out = PL.run_scenarios(seed["store"], seed["after"], sc)
    assert out["scenario_result"].count() == 0
    assert [r["scenario_run_id"] for r in out["rejected"].collect()] == [9]
    assert out["scenario_run"].count() == 0          # no ledger row for a rejected scenario


def test_exec_summary_and_detail(seed):
    top = OV.exec_top(seed["store"], seed["after"], 5).collect()
    assert [r["governorate_id"] for r in top] == [7, 12, 11, 10, 9]
    k = OV.exec_kpis(seed["store"]).collect()[0]
    assert k["total_visitors"] == D("1042513.56") and k["total_beds"] == D("44698.50")
    det = {r["governorate_id"]: r for r in OV.region_detail(seed["store"], seed["after"]).collect()}
    assert det[7]["next_forecast_month"] == dt.date(2026, 1, 1)
    assert det[7]["next_forecast_value"] == D("106439.26")
    assert det[7]["reliability_label"] == "High"
    assert OV.region_detail(seed["store"], seed["after"], 999).count() == 0
    series = OV.region_series(seed["store"], seed["after"]["scores"], 7).collect()
    assert len(series) == 24 and series[0]["month_index"] == dt.date(2024, 1, 1)


def test_run_detail_and_ledgers(seed):
    d = PL.forecast_run_detail(seed["store"], 1).collect()
    assert len(d) == 144 and d[0]["governorate_name_en"] == "Amman"
    assert d[0]["reliability_label"] == "High"
    assert PL.latest_run(seed["store"]["model_run"]).collect()[0]["model_run_id"] == 1
    h = PL.run_header(seed["store"]["model_run"], 1).collect()[0]
    assert (h["model_name"], h["horizon_months"], h["forecast_target"]) == ("seasonal_trend_v2", 12, "total_visitors")


def test_scenario_payload_helper(spark, seed):
    from regiopanel.operators.scenario import scenario_frame
    sc = scenario_frame(spark, [{"governorate_id": 2, "target_month": "2026-12-01", "additional_beds": 500,
                                 "additional_rooms": 200, "induced_demand_ratio": 0.05,
                                 "based_on_model_run_id": None}])
    r = PL.run_scenarios(seed["store"], seed["after"], sc)["scenario_result"].collect()[0]
    assert r["priority_score_after"] == D("58.34")
