"""End-to-end plans over a store: recompute, forecast runs, scenario runs and
their run-detail reads (IND-4, FC-5, FC-6, SC-4, SRC-21).

A store is a dict of DataFrames.  ``with_run``-style helpers return a *new*
store with the run's rows appended (union), mirroring the append-only run
ledgers; ``plans.store.ParquetStore`` persists the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel import schemas as S
from regiopanel.functions import columns as C
from regiopanel.operators import forecast as FC
from regiopanel.operators import indicators as IND
from regiopanel.operators import scenario as SC
from regiopanel.session import materialize
from regiopanel.sources import params as P

G, M = S.G, S.M


# --- IND-4 ------------------------------------------------------------------

def recompute(store: dict, overrides: dict | None = None, persist: bool = False) -> dict:
    """Rebuild the three derived panels from one plan.  With ``persist`` the
    shared frame is checkpointed once and the three tables are projections."""
    params = P.resolve(store.get("params"), overrides)
    scored = IND.recompute_frame(store, params)
    if persist:
        scored = materialize(scored)
    return {"indicators": IND.indicators(scored), "classification": IND.classification(scored),
            "scores": IND.priority_scores(scored), "scored": scored}


# --- FC-5 / FC-6 ------------------------------------------------------------

def run_forecast(store: dict, run_id: int, horizon: int = 12, model_name: str | None = None,
                 persist: bool = False) -> dict:
    """One forecast run over the series of every region of the dimension (of every
    series, in a store without one): header, forecasts, backtest metrics."""
    model = C.model_name(model_name)
    spark, visitors = store["visitors"].sparkSession, store["visitors"]
    if store.get("governorate") is not None:
        visitors = visitors.join(store["governorate"].select(G), G, "left_semi")
    stats = FC.series_stats(FC.series_rows(visitors, model))
    # Forecast rows, backtest metrics and every later reader of the run (the
    # newest-run and per-region next-forecast lookups, scenario baselines) derive
    # from these per-series statistics (one row per series): checkpoint them
    # with ``persist``, else cache them so the window chain runs once.
    stats = materialize(stats) if persist else stats.cache()
    header = spark.range(1).select(
        F.lit(run_id).cast("long").alias("model_run_id"), F.lit(model).alias("model_name"),
        F.lit(S.FORECAST_TARGET).alias("forecast_target"), F.lit(int(horizon)).alias("horizon_months"),
        F.lit("completed").alias("status"),
        F.to_json(F.struct(F.lit(model).alias("model_name"), F.lit(int(horizon)).alias("horizon_months")))
        .alias("run_parameters_json"),
        F.current_timestamp().alias("created_at"))
    return {"model_run": header,
            "forecast": FC.forecasts_from_stats(stats, horizon, model, run_id),
            "backtest": FC.backtest_from_stats(stats, run_id)}


def _append(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def with_forecast_run(store: dict, run: dict) -> dict:
    out = dict(store)
    for k in ("model_run", "forecast", "backtest"):
        out[k] = _append(store.get(k), run[k])
    return out


def list_runs(model_run: DataFrame) -> DataFrame:
    return model_run.select("model_run_id", "model_name", "forecast_target", "horizon_months", "status",
                            "created_at").orderBy(F.col("model_run_id").desc())


def latest_run(model_run: DataFrame) -> DataFrame:
    return list_runs(model_run).limit(1)


def run_header(model_run: DataFrame, run_id: int) -> DataFrame:
    """The run's header row (model, target, horizon, status, parameters)."""
    return model_run.where(F.col("model_run_id") == run_id)


def forecast_run_detail(store: dict, run_id: int) -> DataFrame:
    """FC-6: a run's forecasts with region names and backtest metrics."""
    f = store["forecast"].where(F.col("model_run_id") == run_id)
    m = store["backtest"].where(F.col("model_run_id") == run_id).select(
        "model_run_id", G, "mae", "rmse", "mape", "reliability_label")
    return (f.join(store["governorate"].select(G, "governorate_name_en"), G)
            .join(m, ["model_run_id", G], "left")
            .select("governorate_name_en", "forecast_month", "forecast_value", "lower_bound", "upper_bound",
                    "mae", "rmse", "mape", "reliability_label", G)
            .orderBy(G, "forecast_month"))


# --- scenarios ----------------------------------------------------------------

SCENARIO_PARTITIONS = ["batch_id", "bucket"]
SCENARIO_BUCKETS = 64


def scenario_bucket(scenario_run_id) -> F.Column:
    return F.pmod(F.xxhash64(scenario_run_id), F.lit(SCENARIO_BUCKETS)).cast("int")


def batch_fingerprint(scenarios: DataFrame) -> str:
    """Names a batch by its scenarios, in any order: their number and two sums of row
    hashes."""
    row = [F.col(c).cast("string") for c in sorted(scenarios.columns)]
    n, a, b = scenarios.select(F.xxhash64(*row).alias("a"), F.xxhash64(F.lit("b"), *row).alias("b")).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.col("a").cast("decimal(20,0)")), F.lit(0)),
        F.coalesce(F.sum(F.col("b").cast("decimal(20,0)")), F.lit(0))).first()
    return f"{n}-{int(a) % (1 << 64):016x}{int(b) % (1 << 64):016x}"


def scenario_partitions(df: DataFrame, batch_id: str | None = None) -> DataFrame:
    """``df`` with the columns that scenario tables are partitioned by."""
    if "bucket" in df.columns:
        return df
    return df.withColumns({"batch_id": F.lit(batch_id or batch_fingerprint(df.select("scenario_run_id"))),
                           "bucket": scenario_bucket(F.col("scenario_run_id").cast("long"))})


def run_scenarios(store: dict, derived: dict, scenarios: DataFrame, overrides: dict | None = None) -> dict:
    """Evaluate a batch of scenarios: run ledger rows, results, rejects."""
    params = P.resolve(store.get("params"), overrides)
    baseline = SC.scenario_baseline(scenarios, store, derived)
    rejected = SC.rejected_scenarios(scenarios, store)
    # A rejected scenario leaves no run row (the reference rolls its insert back).
    runs = SC.scenario_runs(scenarios, store.get("model_run")).join(
        rejected.select("scenario_run_id"), "scenario_run_id", "left_anti")
    return {"scenario_run": runs, "scenario_result": SC.evaluate_scenarios(baseline, params),
            "rejected": rejected}


def list_scenario_runs(scenario_run: DataFrame) -> DataFrame:
    return scenario_run.select("scenario_run_id", G, "target_month", "scenario_type", "status",
                               "created_at").orderBy(F.col("scenario_run_id").desc())


def latest_scenario_run(scenario_run: DataFrame) -> DataFrame:
    return list_scenario_runs(scenario_run).limit(1)


def with_scenario_run(store: dict, run: dict) -> dict:
    out = dict(store)
    for k in ("scenario_run", "scenario_result"):
        out[k] = _append(store.get(k), run[k])
    return out


def scenario_run_header(scenario_run: DataFrame, scenario_run_id: int) -> DataFrame:
    return scenario_run.where(F.col("scenario_run_id") == scenario_run_id)


def scenario_run_detail(store: dict, scenario_run_id: int) -> DataFrame:
    """SC-4: the run's result row with the region name.  A stored table is read in the
    run's bucket only."""
    r = store["scenario_result"]
    if "bucket" in r.columns:
        r = r.where(F.col("bucket") == scenario_bucket(F.lit(scenario_run_id).cast("long"))).drop(*SCENARIO_PARTITIONS)
    r = r.where(F.col("scenario_run_id") == scenario_run_id)
    return r.join(store["governorate"].select(G, "governorate_name_en"), G).limit(1)
