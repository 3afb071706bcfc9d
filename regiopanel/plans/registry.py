"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each query derives the panel from the driver tables (``sources.proxy``) and
runs the library operator over the whole tables.  Fixed run parameters:
run 1 = seasonal_trend_v2, horizon 12; run 2 = seasonal_naive, horizon 24.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiopanel import schemas as S
from regiopanel.functions import geo as GEO
from regiopanel.operators import forecast as FC
from regiopanel.operators import indicators as IND
from regiopanel.operators import overview as OV
from regiopanel.operators import scenario as SC
from regiopanel.plans import jobs as PL
from regiopanel.plans.store import ParquetStore
from regiopanel.sources import ingest as ING
from regiopanel.sources import proxy as PX
from regiopanel.sources import sinks as SINKS
from regiopanel.sources import standin as STAND
from regiopanel.sources import uploads as UP
from regiopanel.sources.params import resolve
from regiopanel.sources.records import CsvRecords

G, M = S.G, S.M


def as_double(df: DataFrame) -> DataFrame:
    """Decimal outputs as DOUBLE (the comparison representation)."""
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def _store(spark, sf_dir):
    return PX.panel_store(spark, sf_dir)


def _with_run1(store):
    return PL.with_forecast_run(store, PL.run_forecast(store, 1, 12, "seasonal_trend_v2"))


def _with_runs12(store):
    s = _with_run1(store)
    return PL.with_forecast_run(s, PL.run_forecast(s, 2, 24, "seasonal_naive"))


def _derived(store):
    return PL.recompute(store)


# --- indicators -----------------------------------------------------------------

def q_indicators(spark, d):
    return as_double(_derived(_store(spark, d))["indicators"])


def q_yoy_calendar(spark, d):
    st = _store(spark, d)
    ind = IND.indicator_frame(st["visitors"], st["rooms_beds"], st["occupancy"])
    return as_double(ind.select(G, M, "total_visitors", "prev_total_visitors"))


def q_yoy_positional(spark, d):
    rows = FC.series_rows(_store(spark, d)["visitors"], "seasonal_naive")
    return rows.select(G, M, F.col("v").alias("total_visitors"), F.col("prev").alias("lag12_total_visitors"),
                       F.col("rn").alias("position"))


def q_classification(spark, d):
    return _derived(_store(spark, d))["classification"]


def q_priority_scores(spark, d):
    return as_double(_derived(_store(spark, d))["scores"])


def q_recompute_with_forecast(spark, d):
    st = _with_run1(_store(spark, d))
    scored = IND.recompute_frame(st, resolve(st["params"]))
    return as_double(scored.select(G, M, "forecast_pressure_index", "capacity_classification", "priority_score",
                                   "forecast_component"))


def q_components(spark, d):
    """PRJ-7/8: the four weighted components and the capped score, after a
    seasonal-trend forecast run (all four components active)."""
    st = _with_run1(_store(spark, d))
    dv = _derived(st)
    return as_double(dv["scores"].select(G, M, *IND.COMPONENT_COLS, "priority_score"))


# --- overview family --------------------------------------------------------------

def _full(spark, d):
    st = _with_run1(_store(spark, d))
    return st, _derived(st)


def q_region_overview(spark, d):
    st, dv = _full(spark, d)
    return as_double(OV.region_overview(st, dv))


def q_latest_overview(spark, d):
    return as_double(OV.latest_overview(_store(spark, d)))


def q_region_rank(spark, d):
    st, dv = _full(spark, d)
    return as_double(OV.region_rank(OV.region_overview(st, dv)).select(G, "priority_score", "investment_rank"))


def q_kpis(spark, d):
    st, dv = _full(spark, d)
    return as_double(OV.kpis(st, dv["scores"]))


def q_region_series(spark, d):
    st, dv = _full(spark, d)
    return as_double(OV.region_series(st, dv["scores"]))


def q_region_detail(spark, d):
    st, dv = _full(spark, d)
    return as_double(OV.region_detail(st, dv))


def q_exec_kpis(spark, d):
    return as_double(OV.exec_kpis(_store(spark, d)))


def q_exec_top5(spark, d):
    st, dv = _full(spark, d)
    return as_double(OV.exec_top(st, dv, 5))


def q_metric_bins(spark, d):
    st, dv = _full(spark, d)
    ov = OV.region_overview(st, dv)
    cols = [G] + [OV.C.metric_bin(m, F.col(m)).alias(f"{m}_bin") for m in S.METRIC_BINS] + [
        OV.C.metric_bin(S.CLASS_METRIC, F.col(S.CLASS_METRIC)).alias(f"{S.CLASS_METRIC}_bin"),
        OV.C.percent("latest_average_occupancy_rate").alias("occupancy_pct")]
    return ov.select(*cols)


def q_name_join(spark, d):
    st, dv = _full(spark, d)
    return as_double(OV.map_dataset(st["boundaries"], OV.region_overview(st, dv, ordered=False), "priority_score"))


def q_scaled_series(spark, d):
    st, dv = _full(spark, d)
    s = OV.scaled_series(OV.region_series(st, dv["scores"], ordered=False))
    return s.select(G, M, "total_visitors_scaled", "priority_score_scaled")


def q_sites_with_coords(spark, d):
    return as_double(OV.sites_with_coords(_store(spark, d)["sites"]))


def q_geojson_features(spark, d):
    """WKT boundary import + GeoJSON rendering for one rectangle per customer."""
    cust = PX.read_table(spark, d, "customer")
    b = ING.parse_boundaries(PX.rectangle_wkt(cust, "c_custkey", "C", "c_name"))
    return SINKS.geojson_features(b)


def q_overview_export(spark, d):
    st, dv = _full(spark, d)
    return as_double(SINKS.overview_export(st, dv))


def q_region_export(spark, d):
    st, dv = _full(spark, d)
    return as_double(SINKS.region_export(st, dv["scores"]))


# --- forecasting ------------------------------------------------------------------

def q_forecast_trend(spark, d):
    return as_double(FC.forecast(_store(spark, d)["visitors"], 12, "seasonal_trend_v2", 1))


def q_forecast_naive(spark, d):
    return as_double(FC.forecast(_store(spark, d)["visitors"], 12, "seasonal_naive", 1))


def q_forecast_horizon24(spark, d):
    return as_double(FC.forecast(_store(spark, d)["visitors"], 24, "seasonal_trend_v2", 1))


def q_backtest_trend(spark, d):
    return as_double(FC.backtest(_store(spark, d)["visitors"], "seasonal_trend_v2", 1))


def q_backtest_naive(spark, d):
    return as_double(FC.backtest(_store(spark, d)["visitors"], "seasonal_naive", 1))


def q_forecast_stats(spark, d):
    stats = FC.series_stats(FC.series_rows(_store(spark, d)["visitors"], "seasonal_trend_v2"))
    return stats.select(G, "n", F.round("avg_growth", 6).alias("avg_growth"), F.round("sigma", 4).alias("sigma"),
                        "last_month")


def q_last12(spark, d):
    return as_double(FC.last_observations(_store(spark, d)["visitors"], 12))


def q_next_fc_latest_run(spark, d):
    st = _with_runs12(_store(spark, d))
    return as_double(IND.next_forecast_latest_run(st["model_run"], st["forecast"]))


def q_next_fc_per_region(spark, d):
    st = _with_runs12(_store(spark, d))
    return as_double(IND.next_forecast_per_region(st["model_run"], st["forecast"], st["backtest"]))


def q_forecast_run_detail(spark, d):
    st = _with_runs12(_store(spark, d))
    return as_double(PL.forecast_run_detail(st, 1))


def q_top4_per_region(spark, d):
    st = _with_run1(_store(spark, d))
    return as_double(OV.top_per_group(PL.forecast_run_detail(st, 1), 4, 4)
                     .select(G, "governorate_name_en", "forecast_month", "forecast_value", "row_in_group"))


# --- scenarios --------------------------------------------------------------------

def scenarios_from_forecast(st: dict) -> DataFrame:
    """Scenario batch: every (region, forecast month) of run 1, plus a month
    beyond the forecast horizon (40 months after each region's last history
    month, so the baseline falls back to history), each at +0 and +500 beds."""
    fc = st["forecast"].select(G, F.col("forecast_month").alias("target_month"))
    beyond = st["visitors"].groupBy(G).agg(F.add_months(F.max(M), 40).alias("target_month"))
    months = fc.unionByName(beyond)
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    return months.select(G, "target_month", k).select(
        (F.col(G).cast("long") * 10_000_000 + F.year("target_month") * 1000 + F.month("target_month") * 10
         + F.col("k")).alias("scenario_run_id"),
        G, "target_month",
        (F.col("k") * 500).cast("int").alias("additional_beds"),
        (F.col("k") * 200).cast("int").alias("additional_rooms"),
        F.lit(Decimal("0.0500")).cast("decimal(10,4)").alias("induced_demand_ratio"),
        F.lit(None).cast("long").alias("based_on_model_run_id"))


def q_scenario_baseline(spark, d):
    st, dv = _full(spark, d)
    b = SC.scenario_baseline(scenarios_from_forecast(st), st, dv)
    return as_double(b.select("scenario_run_id", G, "target_month", "based_on_model_run_id", "baseline_demand",
                              "baseline_beds", "occupancy_pressure", "growth_pressure", "capacity_status_before"))


def q_scenario_eval(spark, d):
    st, dv = _full(spark, d)
    return as_double(PL.run_scenarios(st, dv, scenarios_from_forecast(st))["scenario_result"])


def q_scenario_rejects(spark, d):
    st, dv = _full(spark, d)
    sc = scenarios_from_forecast(st)
    return SC.rejected_scenarios(sc, st).select("scenario_run_id", G, "error_message")


# --- ingest -----------------------------------------------------------------------

def _import(spark, d):
    orders = PX.read_table(spark, d, "orders")
    return ING.import_rows(STAND.visitors_import_rows(orders), "visitors_monthly")


def q_import_good(spark, d):
    return as_double(_import(spark, d)["loaded"])


def q_import_errors(spark, d):
    return _import(spark, d)["errors"]


def q_import_summary(spark, d):
    return _import(spark, d)["summary"]


def q_import_duplicates(spark, d):
    return ING.duplicate_keys(_import(spark, d)["typed"], "visitors_monthly")


def q_import_lastwins(spark, d):
    """Keys loaded from more than one good row: the winning row and value."""
    typed = _import(spark, d)["typed"]
    return as_double(typed.where("_ok").groupBy(G, M).agg(
        F.count(F.lit(1)).alias("n_good_rows"), F.max(ING.ROW).alias("winning_row"),
        F.max_by("total_visitors", ING.ROW).alias("total_visitors")).where(F.col("n_good_rows") > 1))


def q_fk_violations(spark, d):
    st = _store(spark, d)
    return as_double(ING.fk_violations(_import(spark, d)["loaded"], st["governorate"]))


# --- CSV text ---------------------------------------------------------------------

def q_csv_records(spark, d):
    """Every document out of CSV text with quotes and line breaks, read in splits, with
    its place among all records."""
    docs = PX.read_table(spark, d, "documents")
    records = CsvRecords(spark, UP.documents_upload(docs), UP.split_bytes_for(docs, "text"))
    (_, columns, _), = records.headers
    text = F.coalesce("text", F.lit(""))
    return records.ordinals(records.rows(columns)).select(
        "ordinal", F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


def _upload(spark, d, kind):
    table, make, dataset_type = {
        "visitors": ("orders", UP.visitors_upload, "visitors_monthly"),
        "rooms_beds": ("lineitem", UP.rooms_beds_upload, "rooms_beds_monthly"),
        "occupancy": ("lineitem", UP.occupancy_upload, "hotel_occupancy_monthly")}[kind]
    rows = PX.read_table(spark, d, table)
    path = make(rows)
    return ING.import_csv(spark, path, dataset_type, split_bytes=UP.split_bytes_of(spark, path))


def q_import_visitors_csv(spark, d):
    return as_double(_upload(spark, d, "visitors")["loaded"])


def q_import_rooms_beds(spark, d):
    """CSV text in files of two column orders: the last good row of each key."""
    return as_double(_upload(spark, d, "rooms_beds")["loaded"])


def q_import_occupancy(spark, d):
    return as_double(_upload(spark, d, "occupancy")["loaded"])


def q_import_csv_errors(spark, d):
    """Rejected records of a CSV import with their places among all records."""
    r = _upload(spark, d, "rooms_beds")
    bad = r["typed"].where("not _ok").select(ING.ROW, "error_message", "raw_row_json")
    return r["records"].ordinals(bad).select("ordinal", "error_message", "raw_row_json")


def q_import_csv_summary(spark, d):
    return _upload(spark, d, "occupancy")["summary"]


def _nested(spark, d):
    """MULTIPOLYGONs with holes, one per customer, out of CSV text."""
    rows = PX.nested_wkt(PX.read_table(spark, d, "customer"))
    folder = UP.new_folder(rows, "upload-boundaries")
    SINKS.write_csv(rows.orderBy(F.col(G).cast("long")), folder)
    return ING.import_csv(spark, folder, "admin_boundaries")


def q_nested_boundaries(spark, d):
    """SRC-4 and SRC-19 on nested rings: areas without the holes, and the features."""
    loaded = _nested(spark, d)["loaded"]
    area = loaded.select(G, F.size("boundary_coords").alias("n_polygons"), F.size(F.col("boundary_coords")[0]).alias("n_rings"),
                         GEO.covered_area(F.col("boundary_coords")).alias("area"))
    return area.join(SINKS.geojson_features(loaded), G)


def q_nested_boundary_errors(spark, d):
    r = _nested(spark, d)
    bad = r["typed"].where("not _ok").select(ING.ROW, "error_message", F.col("_key1").alias("governorate_code"))
    return r["records"].ordinals(bad).select("ordinal", "governorate_code", "error_message")


# --- many series ------------------------------------------------------------------

def q_forecast_parts(spark, d):
    """Seasonal-trend forecast of every part's monthly value: the number of series
    grows with the data; series of fewer than 13 months are skipped."""
    return as_double(FC.forecast(PX.part_series(PX.read_table(spark, d, "lineitem")), 12, "seasonal_trend_v2", 1))


def q_backtest_parts(spark, d):
    return as_double(FC.backtest(PX.part_series(PX.read_table(spark, d, "lineitem")), "seasonal_trend_v2", 1))


# --- the varied panel: every branch occurs ------------------------------------------

def _varied(spark, d):
    """Run 1 under an unknown model name, which falls back to the default, over all
    regions; run 2 leaves out every third region."""
    st = PX.varied_store(spark, d)
    st = PL.with_forecast_run(st, PL.run_forecast(st, 1, 12, "no such model"))
    return st


def _varied_runs12(spark, d):
    st = _varied(spark, d)
    some = st | {"governorate": st["governorate"].where(F.col(G) % 3 != 0)}
    return PL.with_forecast_run(st, PL.run_forecast(some, 2, 24, "seasonal_naive"))


def _on_varied(fn):
    def query(spark, d):
        st = _varied(spark, d)
        return as_double(fn(st, _derived(st)))
    return query


def q_varied_bins(st, dv):
    ov = OV.region_overview(st, dv, ordered=False)
    return ov.select(G, *[OV.C.metric_bin(m, F.col(m)).alias(f"{m}_bin") for m in S.METRIC_BINS],
                     OV.C.metric_bin(S.CLASS_METRIC, F.col(S.CLASS_METRIC)).alias(f"{S.CLASS_METRIC}_bin"),
                     OV.C.percent("latest_average_occupancy_rate").alias("occupancy_pct"))


def q_varied_next_fc_latest_run(spark, d):
    st = _varied_runs12(spark, d)
    return as_double(IND.next_forecast_latest_run(st["model_run"], st["forecast"]))


def q_varied_next_fc_per_region(spark, d):
    st = _varied_runs12(spark, d)
    return as_double(IND.next_forecast_per_region(st["model_run"], st["forecast"], st["backtest"]))


def varied_scenarios(st: dict) -> DataFrame:
    """Every region at its next 14 months (two beyond the horizon), based on no run, on
    run 0 (both mean the newest), on run 1 and on run 2, with 0 to 3000 more beds and
    demand from 40 % less to 90 % more."""
    last = st["visitors"].groupBy(G).agg(F.max(M).alias("last"))
    rows = last.select(G, "last", F.explode(F.sequence(F.lit(1), F.lit(14))).alias("i")) \
        .select(G, "last", "i", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    return rows.select(
        ((F.col(G).cast("long") * 100 + F.col("i")) * 10 + F.col("k")).alias("scenario_run_id"), G,
        F.add_months("last", F.col("i")).alias("target_month"), (F.col("k") * 1000).cast("int").alias("additional_beds"),
        F.lit(0).alias("additional_rooms"), ((F.col("i") - 5) / 10).cast("decimal(10,4)").alias("induced_demand_ratio"),
        F.when(F.col("k") > 0, F.col("k") - 1).cast("long").alias("based_on_model_run_id"))


def q_varied_scenario_eval(spark, d):
    st = _varied_runs12(spark, d)
    return as_double(PL.run_scenarios(st, _derived(st), varied_scenarios(st))["scenario_result"])


def q_varied_scenario_rejects(spark, d):
    st = PX.varied_store(spark, d)
    return SC.rejected_scenarios(varied_scenarios(st), st).select("scenario_run_id", G, "error_message")


def q_varied_backtest(spark, d):
    return as_double(_varied(spark, d)["backtest"])


def q_varied_forecast(spark, d):
    return as_double(_varied(spark, d)["forecast"])


def q_varied_sites(spark, d):
    return as_double(OV.sites_with_coords(PX.varied_store(spark, d)["sites"]))


def q_site_listing(spark, d):
    """SRC-22: all sites in name order, by their place in it."""
    return as_double(OV.global_row_number(OV.list_sites(PX.varied_store(spark, d)["sites"]), ["site_name_en", "tourism_site_id"]))


def q_one_region_series(spark, d):
    """FLT-1: the series of one region, the filter at the scan."""
    st, dv = _full(spark, d)
    return as_double(OV.region_series(st, dv["scores"], 7))


def q_one_region_detail(spark, d):
    st, dv = _full(spark, d)
    return as_double(OV.region_detail(st, dv, 7))


# --- stored tables ------------------------------------------------------------------

def _stored(spark, d):
    """The panel in a store of its own, after recompute, forecast and recompute."""
    store = ParquetStore(spark, UP.new_folder(spark.range(0), "store"))
    st = PX.panel_store(spark, d)
    store.save({n: st[n] for n in ("governorate", "visitors", "rooms_beds", "occupancy", "sites", "boundaries", "params")})
    store.recompute()
    store.run_forecast(1, 12, "seasonal_trend_v2")
    store.recompute()
    return store


def _stored_frames(store):
    loaded = store.load()
    return loaded, {k: loaded[k] for k in ("indicators", "classification", "scores")}


def q_stored_overview(spark, d):
    """OV-2 on stored tables."""
    return as_double(OV.region_overview(*_stored_frames(_stored(spark, d))))


def q_stored_kpis(spark, d):
    st, dv = _stored_frames(_stored(spark, d))
    return as_double(OV.kpis(st, dv["scores"]))


def _stored_scenarios(spark, d):
    store = _stored(spark, d)
    st, _ = _stored_frames(store)
    for _ in range(2):      # the second run of the batch changes nothing
        store.run_scenarios(scenarios_from_forecast(st))
    return store


def q_stored_scenarios(spark, d):
    """SC-2 and SC-3 through the stored, batch-keyed ledgers."""
    return as_double(_stored_scenarios(spark, d).read("scenario_result").drop(*PL.SCENARIO_PARTITIONS))


def q_scenario_run_detail(spark, d):
    """SC-4: the newest scenario's stored result with the region name."""
    store = _stored_scenarios(spark, d)
    newest = store.read("scenario_run").agg(F.max("scenario_run_id")).first()[0]
    return as_double(store.scenario_run_detail(newest))


def q_stored_import(spark, d):
    """SRC-1, SRC-10, SRC-13: a CSV import into the store replaces its visitors; rows of
    unknown regions are quarantined."""
    store = ParquetStore(spark, UP.new_folder(spark.range(0), "store"))
    st = PX.panel_store(spark, d)
    store.save({n: st[n] for n in ("governorate", "visitors", "params")})
    store.import_csv(UP.visitors_upload(PX.read_table(spark, d, "orders")), "visitors_monthly", 1)
    return as_double(store.read("visitors"))


VARIED = {
    "varied_overview": _on_varied(OV.region_overview),
    "varied_latest_overview": _on_varied(lambda st, dv: OV.latest_overview(st)),
    "varied_kpis": _on_varied(lambda st, dv: OV.kpis(st, dv["scores"])),
    "varied_exec_top5": _on_varied(lambda st, dv: OV.exec_top(st, dv, 5)),
    "varied_region_detail": _on_varied(OV.region_detail),
    "varied_metric_bins": _on_varied(q_varied_bins),
    "varied_name_join": _on_varied(lambda st, dv: OV.map_dataset(
        st["boundaries"], OV.region_overview(st, dv, ordered=False), "priority_score")),
    "varied_forecast": q_varied_forecast,
    "varied_backtest": q_varied_backtest,
    "varied_next_fc_latest_run": q_varied_next_fc_latest_run,
    "varied_next_fc_per_region": q_varied_next_fc_per_region,
    "varied_scenario_eval": q_varied_scenario_eval,
    "varied_scenario_rejects": q_varied_scenario_rejects,
    "varied_sites": q_varied_sites,
    "site_listing": q_site_listing,
}

QUERIES = {
    "indicators": q_indicators,
    "yoy_calendar": q_yoy_calendar,
    "yoy_positional": q_yoy_positional,
    "classification": q_classification,
    "priority_scores": q_priority_scores,
    "recompute_with_forecast": q_recompute_with_forecast,
    "components": q_components,
    "region_overview": q_region_overview,
    "latest_overview": q_latest_overview,
    "region_rank": q_region_rank,
    "kpis": q_kpis,
    "region_series": q_region_series,
    "region_detail": q_region_detail,
    "exec_kpis": q_exec_kpis,
    "exec_top5": q_exec_top5,
    "metric_bins": q_metric_bins,
    "name_join": q_name_join,
    "scaled_series": q_scaled_series,
    "sites_with_coords": q_sites_with_coords,
    "geojson_features": q_geojson_features,
    "overview_export": q_overview_export,
    "region_export": q_region_export,
    "forecast_trend": q_forecast_trend,
    "forecast_naive": q_forecast_naive,
    "forecast_horizon24": q_forecast_horizon24,
    "backtest_trend": q_backtest_trend,
    "backtest_naive": q_backtest_naive,
    "forecast_stats": q_forecast_stats,
    "last12": q_last12,
    "next_fc_latest_run": q_next_fc_latest_run,
    "next_fc_per_region": q_next_fc_per_region,
    "forecast_run_detail": q_forecast_run_detail,
    "top4_per_region": q_top4_per_region,
    "scenario_baseline": q_scenario_baseline,
    "scenario_eval": q_scenario_eval,
    "scenario_rejects": q_scenario_rejects,
    "import_good": q_import_good,
    "import_errors": q_import_errors,
    "import_summary": q_import_summary,
    "import_duplicates": q_import_duplicates,
    "import_lastwins": q_import_lastwins,
    "fk_violations": q_fk_violations,
    "csv_records": q_csv_records,
    "import_visitors_csv": q_import_visitors_csv,
    "import_rooms_beds": q_import_rooms_beds,
    "import_occupancy": q_import_occupancy,
    "import_csv_errors": q_import_csv_errors,
    "import_csv_summary": q_import_csv_summary,
    "nested_boundaries": q_nested_boundaries,
    "nested_boundary_errors": q_nested_boundary_errors,
    "forecast_parts": q_forecast_parts,
    "backtest_parts": q_backtest_parts,
    "one_region_series": q_one_region_series,
    "one_region_detail": q_one_region_detail,
    "stored_overview": q_stored_overview,
    "stored_kpis": q_stored_kpis,
    "stored_scenarios": q_stored_scenarios,
    "scenario_run_detail": q_scenario_run_detail,
    "stored_import": q_stored_import,
} | VARIED
