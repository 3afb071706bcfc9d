"""Batch what-if evaluation of bed-addition scenarios (SC-1..SC-3, SC-5).

The reference evaluates one scenario per request; here a whole DataFrame of
scenarios (any number per region) is evaluated in one plan as column
arithmetic.  Per-region baselines are reduced to one row per region *before*
they meet the scenarios, so the scenario join is against a region-sized frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel import schemas as S
from regiopanel.functions import columns as C
from regiopanel.operators.indicators import latest_run_id

G, M = S.G, S.M


def latest_history(store: dict, derived: dict) -> DataFrame:
    """WN-7: per region, the newest month having both visitors and beds, with
    its occupancy, growth pressure and class (one row per region).

    The month comes from the keys alone, a hash aggregate of fixed-width values.  Facts
    and derived panels are then filtered by the set of these months, a scalar subquery:
    on stored tables a partition filter at run time, so old months are not read."""
    keys = store["visitors"].select(G, M).join(store["rooms_beds"].select(G, M), [G, M])
    last = keys.groupBy(G).agg(F.max(M).alias(M))
    months = last.agg(F.collect_set(M)).scalar()       # at most one value per month of the panel
    recent = lambda df: df.where(F.array_contains(months, F.col(M)))
    out = last.join(recent(store["visitors"].select(G, M, "total_visitors")), [G, M]) \
        .join(recent(store["rooms_beds"].select(G, M, "total_rooms", "total_beds")), [G, M]) \
        .join(recent(store["occupancy"].select(G, M, "average_occupancy_rate")), [G, M], "left")
    if derived.get("scored") is not None:
        return out.join(recent(derived["scored"].select(G, M, "growth_pressure_index", "capacity_classification")), [G, M], "left")
    return out.join(recent(derived["indicators"].select(G, M, "growth_pressure_index")), [G, M], "left") \
        .join(recent(derived["classification"].select(G, M, "capacity_classification")), [G, M], "left")


def resolve_base_run(scenarios: DataFrame, model_run: DataFrame | None) -> DataFrame:
    """SC-5: a missing or 0 base run means the newest run."""
    base = F.nullif(F.col("based_on_model_run_id"), F.lit(0))
    if model_run is None:
        return scenarios.withColumn("based_on_model_run_id", base.cast("long"))
    latest = latest_run_id(model_run).select(F.col("model_run_id").alias("_latest_run"))
    return (scenarios.join(F.broadcast(latest), how="left")   # 1-row side
            .withColumn("based_on_model_run_id", F.coalesce(base, F.col("_latest_run")).cast("long"))
            .drop("_latest_run"))


def scenario_baseline(scenarios: DataFrame, store: dict, derived: dict) -> DataFrame:
    """SC-1: baseline demand = the base run's forecast for the target month,
    else the last historical visitors; plus beds, pressures and class."""
    sc = resolve_base_run(scenarios, store.get("model_run"))
    hist = latest_history(store, derived)
    df = sc.join(hist, G)   # SC-3: scenarios without history drop out (see rejected_scenarios)
    fc = store.get("forecast")
    if fc is not None:
        f = fc.select(F.col("model_run_id").alias("based_on_model_run_id"), G,
                      F.col("forecast_month").alias("target_month"), F.col("forecast_value").alias("_fc"))
        df = df.join(f, ["based_on_model_run_id", G, "target_month"], "left")
    else:
        df = df.withColumn("_fc", F.lit(None).cast(S.MONEY))
    return df.select(
        *[F.col(c) for c in sc.columns],
        F.coalesce("_fc", "total_visitors").alias("baseline_demand"),
        F.col("total_beds").alias("baseline_beds"),
        F.col("total_rooms").alias("baseline_rooms"),
        (F.coalesce("average_occupancy_rate", F.lit(0)) * 100).alias("occupancy_pressure"),
        F.coalesce("growth_pressure_index", F.lit(0)).alias("growth_pressure"),
        F.coalesce("capacity_classification", F.lit(S.BALANCED)).alias("capacity_status_before"),
    )


def rejected_scenarios(scenarios: DataFrame, store: dict) -> DataFrame:
    """SC-3: scenarios whose region has no month with both visitors and beds."""
    have = store["visitors"].select(G, M).join(store["rooms_beds"].select(G, M), [G, M]).select(G).distinct()
    return (scenarios.join(have, G, "left_anti")
            .withColumn("error_message", F.lit("Unable to compute scenario baseline")))


def evaluate_scenarios(baseline: DataFrame, params: dict) -> DataFrame:
    """SC-2: demand/beds before and after, visitors per 1000 beds, pressures,
    scores before/after, class after (re-classified scaled occupancy) and the
    recommendation.  Additional rooms never change the result."""
    d = lambda c: F.col(c).cast("double")
    bd = F.coalesce(d("baseline_demand"), F.lit(0.0))
    bb = F.coalesce(d("baseline_beds"), F.lit(0.0))
    sd = bd * (F.lit(1.0) + F.coalesce(d("induced_demand_ratio"), F.lit(0.0)))
    sb = bb + F.coalesce(d("additional_beds"), F.lit(0.0))
    occ = F.coalesce(d("occupancy_pressure"), F.lit(0.0))
    gp = F.greatest(F.lit(0.0), F.coalesce(d("growth_pressure"), F.lit(0.0)))
    vb = F.when(bb > 0, bd / bb * 1000)
    va = F.when(sb > 0, sd / sb * 1000)
    fp_b = F.when(bb > 0, F.least(F.lit(100.0), bd / bb * 4)).otherwise(F.lit(0.0))
    fp_a = F.when(sb > 0, F.least(F.lit(100.0), sd / sb * 4)).otherwise(F.lit(0.0))
    vp_b = F.least(F.lit(100.0), F.coalesce(vb / 25.0, F.lit(0.0)))
    vp_a = F.least(F.lit(100.0), F.coalesce(va / 25.0, F.lit(0.0)))
    w_o, w_g = params["priority_weight_occupancy"], params["priority_weight_growth"]
    w_v, w_f = params["priority_weight_visitor_bed"], params["priority_weight_forecast"]
    common = occ * w_o + F.least(gp, F.lit(100.0)) * w_g
    pb = F.least(F.lit(100.0), common + vp_b * w_v + fp_b * w_f)
    pa = F.least(F.lit(100.0), common + vp_a * w_v + fp_a * w_f)
    scaled = occ * F.when(sb != 0, bb / sb).otherwise(F.lit(1.0))
    after = C.classify(scaled, params["classification_tight_threshold"], params["classification_balanced_threshold"])
    r2 = lambda x: F.round(x, 2).cast(S.MONEY)
    return baseline.select(
        "scenario_run_id", G, "target_month",
        r2(bd).alias("baseline_demand"), r2(sd).alias("scenario_demand"), r2(sd - bd).alias("demand_delta"),
        r2(bb).alias("baseline_beds"), r2(sb).alias("scenario_beds"),
        F.coalesce(F.col("additional_beds"), F.lit(0)).alias("beds_delta"),
        F.round(pb, 2).cast(S.SCORE).alias("priority_score_before"),
        F.round(pa, 2).cast(S.SCORE).alias("priority_score_after"),
        "capacity_status_before",
        after.alias("capacity_status_after"),
        F.round(vb, 4).cast(S.INDEX).alias("visitors_per_1000_beds_before"),
        F.round(va, 4).cast(S.INDEX).alias("visitors_per_1000_beds_after"),
        C.recommendation(pb, pa).alias("recommendation_text"),
    )


def scenario_runs(scenarios: DataFrame, model_run: DataFrame | None) -> DataFrame:
    """Scenario run ledger rows (one per scenario)."""
    return resolve_base_run(scenarios, model_run).select(
        "scenario_run_id", G, "target_month", F.lit(S.SCENARIO_TYPE).alias("scenario_type"),
        "additional_beds", "additional_rooms", "induced_demand_ratio", "based_on_model_run_id",
        F.lit("completed").alias("status"), F.current_timestamp().alias("created_at"))


def scenario_frame(spark, payloads: list[dict], first_run_id: int = 1) -> DataFrame:
    """Scenarios DataFrame from request-style payload dicts (governorate_id,
    target_month, additional_beds, additional_rooms, induced_demand_ratio,
    based_on_model_run_id); missing numbers default to 0 / latest run."""
    import datetime as _dt
    from decimal import Decimal as _D
    rows = []
    for i, p in enumerate(payloads):
        tm = p["target_month"]
        if isinstance(tm, str):
            tm = _dt.date.fromisoformat(tm[:10])
        rows.append((int(p.get("scenario_run_id", first_run_id + i)), int(p["governorate_id"]), tm,
                     int(p.get("additional_beds", 0) or 0), int(p.get("additional_rooms", 0) or 0),
                     _D(str(p.get("induced_demand_ratio", 0) or 0)), p.get("based_on_model_run_id")))
    return spark.createDataFrame(rows, S.SCENARIOS)
