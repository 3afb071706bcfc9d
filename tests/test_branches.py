"""Every branch of the operators occurs in the varied panel at sf0.01, so a query that
ignored one would not match its SQL."""
import datetime as dt

import pytest

import __spark_entry__ as E
from regiopanel import schemas as S
from regiopanel.sources import proxy as PX

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    kept = {}

    def of(name):
        if name not in kept:
            kept[name] = E.queries()[name](spark, SF).collect()
        return kept[name]
    return of


def test_reliability_and_short_series(spark, rows):
    assert {r.reliability_label for r in rows("varied_backtest")} == {"High", "Moderate", "Low"}
    months = dict(PX.varied_store(spark, SF)["visitors"].groupBy(S.G).count().collect())
    forecast = {r.governorate_id for r in rows("varied_forecast")}
    assert forecast == {g for g, n in months.items() if n >= S.MIN_HISTORY} and min(months.values()) < S.MIN_HISTORY
    assert {n for n in months.values() if n in (12, 13)} == {12, 13}
    parts = {r.governorate_id for r in rows("forecast_parts")}
    assert 0 < len(parts) < PX.part_series(PX.read_table(spark, SF, "lineitem")).select(S.G).distinct().count()


def test_scores_threshold_top_and_bins(rows):
    overview = rows("varied_overview")
    assert 0 < rows("varied_kpis")[0].high_priority_zones == sum(r.priority_score >= 70 for r in overview if r.priority_score) < len(overview)
    assert len(rows("varied_exec_top5")) == 5 < sum(r.priority_score is not None for r in overview)
    bins = rows("varied_metric_bins")
    for metric, edges in S.METRIC_BINS.items():
        found = {r[f"{metric}_bin"] for r in bins}
        assert len(found) >= 4 and found <= {label for _, label in edges} | {S.NO_DATA}, (metric, found)
    assert {r.capacity_classification_bin for r in bins} >= {S.UNDER, S.BALANCED, S.OVER}
    assert any(r.latest_total_beds is None for r in overview) and any(r.latest_average_occupancy_rate is None for r in overview)


def test_names_are_matched_by_their_folded_form(spark, rows):
    names = {r.governorate_id: r.governorate_name_en for r in PX.varied_store(spark, SF)["governorate"].collect()}
    joined = rows("varied_name_join")
    assert all(r.metric_governorate_id == r.feature_governorate_id and r.feature_name != names[r.feature_governorate_id] for r in joined)
    assert len({r.metric_bin for r in joined}) >= 3


def test_next_forecast_of_a_region_that_the_newest_run_skips(rows):
    newest = {r.governorate_id for r in rows("varied_next_fc_latest_run")}
    each = {r.governorate_id: r.model_run_id for r in rows("varied_next_fc_per_region")}
    assert newest < set(each) and set(each.values()) == {1, 2}
    assert {g for g, run in each.items() if run == 2} == newest


def test_sites_without_coordinates(spark, rows):
    listed = rows("site_listing")
    assert any(r.latitude == 0 for r in listed) and any(r.longitude is None for r in listed)
    assert len(rows("varied_sites")) == sum(bool(r.latitude) and bool(r.longitude) for r in listed) < len(listed)
    assert [r.site_name_en for r in sorted(listed, key=lambda r: r.row_number)] == sorted(r.site_name_en for r in listed)


def test_scenarios(spark, rows):
    results = rows("varied_scenario_eval")
    assert {r.recommendation_text for r in results} == {S.NOTE_IMPROVES, S.NOTE_WORSENS, S.NOTE_MODEST}
    assert rows("varied_scenario_rejects") and not {r.governorate_id for r in rows("varied_scenario_rejects")} & {r.governorate_id for r in results}
    by_id = {r.scenario_run_id: r for r in results}
    # no run and run 0 mean the newest run, 2; run 1 gives another demand; beyond the horizon history counts
    region = next(g for g in {r.governorate_id for r in results} if g % 3 and g < 100)
    of = lambda i, k: by_id[(region * 100 + i) * 10 + k]
    assert of(1, 0).baseline_demand == of(1, 1).baseline_demand == of(1, 3).baseline_demand != of(1, 2).baseline_demand
    assert of(14, 2).baseline_demand != of(2, 2).baseline_demand
    assert of(1, 0).target_month < dt.date(2002, 1, 1)
