"""Seasonal forecasts, uncertainty bands and in-sample backtests (FC-1..FC-4).

All series are processed by one plan: a single shuffle on the series key feeds
a chain of window operators (row position, positional lag 12, per-series mean
growth) and a per-series aggregate that reuses the same partitioning.  The
window partitions are bounded: the panel has one row per (region, date), so a
series holds at most one row per calendar day of its span, whatever the raw
data volume.  The "last 12 observations" array is bounded at 12 elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiopanel import schemas as S
from regiopanel.functions import columns as C

G, M = S.G, S.M
NAIVE = "seasonal_naive"


def _prediction(model: str, prev: Column, growth: Column) -> Column:
    return prev if model == NAIVE else prev * (F.lit(1.0) + growth)


def series_rows(visitors: DataFrame, model: str) -> DataFrame:
    """Per-row view: position, positional lag-12 value, series mean YoY growth
    and backtest error, for series with at least MIN_HISTORY rows."""
    w = Window.partitionBy(G).orderBy(M)
    whole = Window.partitionBy(G)
    v = F.col("v")
    prev = F.col("prev")
    rows = (visitors.select(G, M, F.col("total_visitors").cast("double").alias("v"))
            .withColumn("rn", F.row_number().over(w))
            .withColumn("n", F.count(F.lit(1)).over(whole))
            .withColumn("prev", F.lag("v", 12).over(w))          # 12 rows back, not 12 months
            .where(F.col("n") >= S.MIN_HISTORY))
    growth = F.when(prev > 0, (v - prev) / prev)
    rows = rows.withColumn("avg_growth", F.coalesce(F.avg(growth).over(whole), F.lit(S.DEFAULT_GROWTH)))
    pred = _prediction(model, prev, F.col("avg_growth"))
    return rows.withColumn("err", F.when(prev.isNotNull(), v - pred))


def series_stats(rows: DataFrame) -> DataFrame:
    """One row per series: history length, growth, sigma, last month, the last
    12 values in order, and the backtest metrics (AG-6, AG-7, AG-8, WN-4)."""
    v, prev, err = F.col("v"), F.col("prev"), F.col("err")
    in_last12 = F.col("rn") > F.col("n") - 12
    resid = F.when(prev > 0, v - prev)
    return (rows.groupBy(G).agg(
        F.max("n").alias("n"),                     # constant within a series
        F.max("avg_growth").alias("avg_growth"),   # (max, not first: deterministic)
        F.coalesce(F.stddev_pop(resid), F.max(F.when(in_last12, v)) * S.SIGMA_FALLBACK).alias("sigma"),
        F.max(M).alias("last_month"),
        F.sort_array(F.collect_list(F.when(in_last12, F.struct("rn", "v")))).alias("last12"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.when(err.isNotNull() & (v != 0), F.abs(err) / v * 100)).alias("mape"),
    ))


def forecasts_from_stats(stats: DataFrame, horizon: int, model: str, run_id: int) -> DataFrame:
    """FC-1..FC-3: step k uses last12[(k-1) mod 12]; trend multiplies by
    (1 + mean growth) once; bands +-1.28 sigma, lower clipped at 0."""
    if horizon <= 0:  # sequence(1, 0) would count down; no forecast rows
        stats = stats.where(F.lit(False))
    steps = F.sequence(F.lit(1), F.lit(max(int(horizon), 1)))
    f = (stats.select(G, "last_month", "avg_growth", "sigma", "last12", F.explode(steps).alias("step"))
         .withColumn("base", F.element_at("last12", ((F.col("step") - 1) % 12 + 1).cast("int"))["v"]))
    value = _prediction(model, F.col("base"), F.col("avg_growth"))
    half = F.lit(S.BAND_Z) * F.col("sigma")
    lower = F.greatest(F.lit(0.0), value - half)
    upper = F.greatest(lower, value + half)
    return f.select(
        F.lit(run_id).cast("long").alias("model_run_id"),
        G,
        F.add_months("last_month", F.col("step")).alias("forecast_month"),
        C.store_as(F.round(value, 2), S.MONEY).alias("forecast_value"),
        C.store_as(F.round(lower, 2), S.MONEY).alias("lower_bound"),
        C.store_as(F.round(upper, 2), S.MONEY).alias("upper_bound"),
    )


def backtest_from_stats(stats: DataFrame, run_id: int) -> DataFrame:
    """FC-4: in-sample lag-12 backtest metrics and reliability label."""
    return stats.select(
        F.lit(run_id).cast("long").alias("model_run_id"),
        G,
        C.store_as("mae", S.INDEX).alias("mae"),
        C.store_as("rmse", S.INDEX).alias("rmse"),
        C.store_as("mape", S.INDEX).alias("mape"),
        C.reliability("n", "mape").alias("reliability_label"),
    )


def forecast(visitors: DataFrame, horizon: int = 12, model: str | None = None, run_id: int = 1) -> DataFrame:
    model = C.model_name(model)
    return forecasts_from_stats(series_stats(series_rows(visitors, model)), horizon, model, run_id)


def backtest(visitors: DataFrame, model: str | None = None, run_id: int = 1) -> DataFrame:
    model = C.model_name(model)
    return backtest_from_stats(series_stats(series_rows(visitors, model)), run_id)


def last_observations(visitors: DataFrame, k: int = 12) -> DataFrame:
    """WN-4: the last ``k`` observations of each series with position 1..k."""
    w = Window.partitionBy(G).orderBy(F.col(M).desc())
    return (visitors.withColumn("back", F.row_number().over(w)).where(F.col("back") <= k)
            .withColumn("n_kept", F.count(F.lit(1)).over(Window.partitionBy(G)))
            .select(G, M, "total_visitors", (F.col("n_kept") - F.col("back") + 1).alias("position")))
