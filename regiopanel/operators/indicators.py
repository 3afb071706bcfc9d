"""Indicator, classification and priority-score panels (IND-1..IND-4).

Plan shape: the three facts are LEFT-joined on (region, month) -- each input
is shuffled once on that key and the joins reuse the partitioning; the
calendar "12 months ago" value is one more LEFT self-join; the next forecast
(one row per region) is joined on region.  Classification and score are pure
projections of the indicator row: the reference's 1:1 join of indicator and
classification tables on their unique key is folded away, so the three output
panels come from one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel import schemas as S
from regiopanel.functions import columns as C

G, M = S.G, S.M
INDICATOR_COLS = ["visitors_per_1000_beds", "occupancy_pressure_index", "growth_pressure_index",
                  "capacity_adequacy_index", "forecast_pressure_index"]
COMPONENT_COLS = ["occupancy_component", "growth_component", "visitor_bed_component", "forecast_component"]


def latest_run_id(model_run: DataFrame) -> DataFrame:
    """1-row frame: the newest run id (ORDER BY id DESC LIMIT 1)."""
    return model_run.agg(F.max("model_run_id").alias("model_run_id")).where(F.col("model_run_id").isNotNull())


def next_forecast_latest_run(model_run: DataFrame, forecast: DataFrame) -> DataFrame:
    """WN-1: first forecast month per region within the single newest run."""
    fc = forecast.join(F.broadcast(latest_run_id(model_run)), "model_run_id")  # 1-row side
    return (fc.groupBy(G)
            .agg(F.min_by("forecast_value", "forecast_month").alias("next_forecast_value")))


def next_forecast_per_region(model_run: DataFrame, forecast: DataFrame, metrics: DataFrame | None = None
                             ) -> DataFrame:
    """WN-2: first forecast month per region in *that region's* newest run
    (a region skipped by the newest run keeps its older forecast).

    Two hash aggregates of fixed-width values, without a sort: the newest run of each
    region is a max, and the first month of that run one long, so that each column is a
    min_by on it.
    """
    runs = model_run.select("model_run_id")
    fc = forecast.join(runs, "model_run_id")
    newest = fc.groupBy(G).agg(F.max("model_run_id").alias("model_run_id"))
    at = F.unix_date("forecast_month")
    out = fc.join(newest, [G, "model_run_id"]).groupBy(G, "model_run_id").agg(
        F.min("forecast_month").alias("forecast_month"),
        *[F.min_by(c, at).alias(c) for c in ("forecast_value", "lower_bound", "upper_bound")])
    if metrics is not None:
        out = out.join(metrics.select("model_run_id", G, "mae", "rmse", "mape", "reliability_label"),
                       ["model_run_id", G], "left")
    return out


def indicator_frame(visitors: DataFrame, rooms_beds: DataFrame, occupancy: DataFrame,
                    next_fc: DataFrame | None = None) -> DataFrame:
    """Visitors rows with joined facts, previous-year value and next forecast,
    plus the five indicators stored at 4 dp (IND-1)."""
    v = visitors.select(G, M, "total_visitors")
    rb = rooms_beds.select(G, M, "total_rooms", "total_beds")
    o = occupancy.select(G, M, "average_occupancy_rate")
    # JN-2: calendar shift, prev.month = month - 12 months (month-end clamped).
    prev = visitors.select(G, F.col(M).alias("prev_month"), F.col("total_visitors").alias("prev_total_visitors"))
    df = (v.join(rb, [G, M], "left")
          .join(o, [G, M], "left")
          .withColumn("prev_month", F.add_months(M, -12))
          .join(prev, [G, "prev_month"], "left")
          .drop("prev_month"))
    if next_fc is not None:
        df = df.join(next_fc.select(G, "next_forecast_value"), G, "left")
    else:
        df = df.withColumn("next_forecast_value", F.lit(None).cast(S.MONEY))
    return df.select(
        "*",
        C.store_as(C.visitors_per_1000_beds(), S.INDEX).alias("visitors_per_1000_beds"),
        C.store_as(C.occupancy_pressure(), S.INDEX).alias("occupancy_pressure_index"),
        C.store_as(C.growth_pressure(), S.INDEX).alias("growth_pressure_index"),
        C.store_as(C.capacity_adequacy(), S.INDEX).alias("capacity_adequacy_index"),
        C.store_as(C.forecast_pressure(), S.INDEX).alias("forecast_pressure_index"),
    )


def with_scores(ind: DataFrame, params: dict) -> DataFrame:
    """Adds classification (IND-2), components and priority score (IND-3),
    computed on the stored 4-dp indicators."""
    comps = C.raw_components(params)
    cls = C.classify("occupancy_pressure_index", params["classification_tight_threshold"],
                     params["classification_balanced_threshold"])
    return ind.select(
        "*",
        cls.alias("capacity_classification"),
        C.priority_score(comps).cast(S.SCORE).alias("priority_score"),
        *[C.pg_round(c, 2).cast(S.SCORE).alias(n) for c, n in zip(comps, COMPONENT_COLS)],
    ).withColumn("justification_text", C.justification("capacity_classification"))


def indicators(ind_frame: DataFrame) -> DataFrame:
    return ind_frame.select(G, M, *INDICATOR_COLS)


def classification(scored: DataFrame) -> DataFrame:
    return scored.select(G, M, "capacity_classification")


def priority_scores(scored: DataFrame) -> DataFrame:
    return scored.select(G, M, "priority_score", "justification_text", *COMPONENT_COLS)


def recompute_frame(store: dict, params: dict) -> DataFrame:
    """Whole recompute (IND-4) as one frame: facts, indicators, class, score.

    The next forecast comes from the newest run in the store (WN-1); with no
    run yet, forecast pressure is NULL and its component 0.
    """
    next_fc = None
    if store.get("model_run") is not None and store.get("forecast") is not None:
        next_fc = next_forecast_latest_run(store["model_run"], store["forecast"])
    ind = indicator_frame(store["visitors"], store["rooms_beds"], store["occupancy"], next_fc)
    return with_scores(ind, params)


DERIVED_TABLES = {"indicators": INDICATOR_COLS, "classification": ["capacity_classification"],
                  "scores": ["priority_score", "justification_text", *COMPONENT_COLS]}


def recompute(store: dict, params: dict) -> dict:
    """Returns the three derived tables (indicators, classification, scores)
    plus ``scored``, the single frame they are projections of."""
    scored = recompute_frame(store, params)
    return {"indicators": indicators(scored), "classification": classification(scored),
            "scores": priority_scores(scored), "scored": scored}


def derived_columns(derived: dict, cols: list[str], keep=None, base: str | None = None) -> DataFrame:
    """(region, month, *cols) from the derived panels.  ``keep`` filters each table
    on its keys before the join, so month folders are pruned; with ``base`` only the
    keys of that table are returned.

    With the recompute's combined frame this is one projection -- reading
    the three tables separately would re-run the recompute plan once per
    table, since each is pruned differently.  Stored tables (one row per
    key each) are joined on the key."""
    keep = keep or (lambda df: df)
    if derived.get("scored") is not None:
        return keep(derived["scored"].select(G, M, *cols))
    out = None
    for table in sorted(DERIVED_TABLES, key=lambda t: t != base):
        need = [c for c in cols if c in DERIVED_TABLES[table]]
        if need or table == base:
            part = keep(derived[table].select(G, M, *need))
            out = part if out is None else out.join(part, [G, M], "left" if base else "full_outer")
    return out
