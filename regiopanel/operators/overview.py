"""Read-side datasets: KPIs, region overview/detail/series, executive summary,
map dataset, rankings and UI-derived columns (OV-1..OV-7, SRC-22, FLT-6,
WN-5/6/9, PRJ-12..14).

"Latest month" is a global MAX expressed as an uncorrelated scalar
subquery (``DataFrame.scalar()``), as in the reference's SQL: Spark runs it
once per plan (identical subqueries are reused) and each fact is then
*filtered* by it -- no join, and with month-partitioned storage the filter
prunes to one partition.  Everything keyed per region is joined on the region
key; the dimension-sized sides are left to Spark's size-checked join
selection (static estimate + AQE runtime sizes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regiopanel import schemas as S
from regiopanel.functions import columns as C
from regiopanel.functions.names import normalize_name
from regiopanel.functions.ordering import global_row_number
from regiopanel.operators.indicators import COMPONENT_COLS, derived_columns, next_forecast_per_region

G, M = S.G, S.M


LATEST_DERIVED = ["visitors_per_1000_beds", "occupancy_pressure_index", "growth_pressure_index",
                  "forecast_pressure_index", "priority_score", "justification_text", *COMPONENT_COLS,
                  "capacity_classification"]


def latest_month(fact: DataFrame) -> Column:
    """Scalar subquery: the fact's latest month (NULL when the fact is empty)."""
    return fact.agg(F.max(M)).scalar()


def at_latest(fact: DataFrame, latest: Column) -> DataFrame:
    return fact.where(F.col(M) == latest)   # NULL latest -> no rows


def _mean(c: str):
    """Unweighted mean as exact decimal sum / count, returned as DOUBLE."""
    return F.sum(c).cast("double") / F.count(c)


def _score_desc_order():
    return [F.col("priority_score").desc_nulls_last(), F.col(G).asc()]


# --- OV-1 -------------------------------------------------------------------

def _scalar(df: DataFrame, expr: Column) -> Column:
    return df.agg(expr).scalar()


def kpis(store: dict, scores: DataFrame) -> DataFrame:
    """OV-1: one row of uncorrelated scalar subqueries over the latest month."""
    latest = latest_month(store["visitors"])
    vis = at_latest(store["visitors"], latest)
    cap = at_latest(store["rooms_beds"], latest)
    occ = at_latest(store["occupancy"], latest)
    # JN-7: the threshold parameter is attached through a constant-key join; a
    # missing (or non-numeric) parameter yields zero high-priority rows.
    spark = store["visitors"].sparkSession
    params = store.get("params")
    if params is None:   # no parameter table: no threshold, so no high-priority rows
        params = spark.createDataFrame([], S.PARAMS)
    # Exactly one row by construction (global aggregate; NULL when missing,
    # which then matches no score).
    thr = (params.where(F.col("parameter_key") == S.HIGH_PRIORITY_KEY)
           .agg(F.max(F.col("parameter_value").try_cast("double")).alias("thr")))
    hp = (at_latest(scores, latest).crossJoin(F.broadcast(thr))   # 1-row side
          .where(F.col("priority_score").cast("double") >= F.col("thr")))
    return spark.range(1).select(
        latest.cast("string").alias("latest_month"),
        _scalar(vis, F.coalesce(F.sum("total_visitors"), F.lit(0))).alias("total_visitors"),
        _scalar(cap, F.coalesce(F.sum("total_rooms"), F.lit(0))).alias("total_rooms"),
        _scalar(cap, F.coalesce(F.sum("total_beds"), F.lit(0))).alias("total_beds"),
        _scalar(occ, F.coalesce(_mean("average_occupancy_rate"), F.lit(0.0))).alias("average_occupancy_rate"),
        _scalar(hp, F.count(F.lit(1))).alias("high_priority_zones"))


# --- OV-2 / OV-3 ------------------------------------------------------------

def _latest_slices(store: dict):
    latest = latest_month(store["visitors"])
    base = store["governorate"].withColumn(M, latest)   # LEFT JOIN latest ON TRUE
    v = at_latest(store["visitors"], latest).select(G, M, F.col("total_visitors"))
    rb = at_latest(store["rooms_beds"], latest).select(G, M, "total_rooms", "total_beds")
    o = at_latest(store["occupancy"], latest).select(G, M, "average_occupancy_rate")
    return base, v, rb, o, latest


def latest_overview(store: dict) -> DataFrame:
    """OV-3: the latest-month view, one row per region."""
    base, v, rb, o, _ = _latest_slices(store)
    return (base.join(v, [G, M], "left").join(rb, [G, M], "left").join(o, [G, M], "left")
            .select(G, "governorate_code", "governorate_name_en", "total_visitors", "total_rooms",
                    "total_beds", "average_occupancy_rate"))


def region_overview(store: dict, derived: dict, ordered: bool = True) -> DataFrame:
    """OV-2: all regions at the latest month with scores, indicators, class and
    the next forecast of each region's newest run; ranked by score, unless what
    follows has an order of its own."""
    base, v, rb, o, latest = _latest_slices(store)
    d = derived_columns(derived, LATEST_DERIVED, keep=lambda t: at_latest(t, latest))
    df = (base.join(v, [G, M], "left").join(rb, [G, M], "left").join(o, [G, M], "left")
          .join(d, [G, M], "left"))
    if store.get("model_run") is not None and store.get("forecast") is not None:
        fc = next_forecast_per_region(store["model_run"], store["forecast"]).select(
            G, F.col("forecast_value").alias("next_forecast_value"),
            F.col("lower_bound").alias("next_forecast_lower"), F.col("upper_bound").alias("next_forecast_upper"))
        df = df.join(fc, G, "left")
    else:
        for n in ("next_forecast_value", "next_forecast_lower", "next_forecast_upper"):
            df = df.withColumn(n, F.lit(None).cast(S.MONEY))
    df = df.select(
        G, "governorate_code", "governorate_name_en",
        F.col("total_visitors").alias("latest_total_visitors"),
        F.col("total_beds").alias("latest_total_beds"),
        F.col("average_occupancy_rate").alias("latest_average_occupancy_rate"),
        "priority_score", "justification_text", *COMPONENT_COLS,
        "visitors_per_1000_beds", "occupancy_pressure_index", "growth_pressure_index", "forecast_pressure_index",
        "capacity_classification", "next_forecast_value", "next_forecast_lower", "next_forecast_upper")
    return df.orderBy(*_score_desc_order()) if ordered else df


def region_rank(overview: DataFrame) -> DataFrame:
    """WN-6: investment rank = position in the score ordering (distributed
    numbering; no single-task global window)."""
    return global_row_number(overview.select(G, "governorate_name_en", "priority_score",
                                             "capacity_classification", "next_forecast_value",
                                             "justification_text"),
                             _score_desc_order(), "investment_rank")


# --- OV-4 / OV-5 ------------------------------------------------------------

def region_series(store: dict, scores: DataFrame, governorate_id: int | None = None, ordered: bool = True) -> DataFrame:
    """OV-4: per-region time series; all regions when ``governorate_id`` is None."""
    v = store["visitors"].select(G, M, "total_visitors")
    if governorate_id is not None:
        v = v.where(F.col(G) == governorate_id)   # FLT-1, pushed to the scan
    df = (v.join(store["rooms_beds"].select(G, M, "total_rooms", "total_beds"), [G, M], "left")
          .join(store["occupancy"].select(G, M, "average_occupancy_rate"), [G, M], "left")
          .join(scores.select(G, M, "priority_score"), [G, M], "left")
          .select(G, M, "total_visitors", "total_rooms", "total_beds", "average_occupancy_rate", "priority_score"))
    return df.orderBy(G, M) if ordered else df


def region_detail(store: dict, derived: dict, governorate_id: int | None = None) -> DataFrame:
    """OV-5: latest-month detail row per region (unknown region -> no row)."""
    latest = latest_month(store["visitors"])
    base = store["governorate"].select(G, "governorate_name_en")
    if governorate_id is not None:
        base = base.where(F.col(G) == governorate_id)
    base = base.withColumn(M, latest)
    def keep(t):
        t = at_latest(t, latest)
        return t if governorate_id is None else t.where(F.col(G) == governorate_id)
    df = base.join(derived_columns(derived, LATEST_DERIVED, keep=keep), [G, M], "left")
    fc_cols = ["next_forecast_month", "next_forecast_value", "next_forecast_lower", "next_forecast_upper",
               "mape", "mae", "rmse", "reliability_label"]
    if store.get("model_run") is not None and store.get("forecast") is not None:
        fc = next_forecast_per_region(store["model_run"], store["forecast"], store.get("backtest")).select(
            G, F.col("forecast_month").alias("next_forecast_month"),
            F.col("forecast_value").alias("next_forecast_value"),
            F.col("lower_bound").alias("next_forecast_lower"), F.col("upper_bound").alias("next_forecast_upper"),
            "mape", "mae", "rmse", "reliability_label")
        df = df.join(fc, G, "left")
    else:
        for n in fc_cols:
            df = df.withColumn(n, F.lit(None))
    return df.select(G, "governorate_name_en", "priority_score", "justification_text", *COMPONENT_COLS,
                     "visitors_per_1000_beds", "occupancy_pressure_index", "growth_pressure_index",
                     "forecast_pressure_index", "capacity_classification", *fc_cols)


# --- OV-6 -------------------------------------------------------------------

def exec_kpis(store: dict) -> DataFrame:
    """KPI part of the executive summary (sums not coalesced)."""
    latest = latest_month(store["visitors"])
    return store["visitors"].sparkSession.range(1).select(
        latest.cast("string").alias("latest_month"),
        _scalar(at_latest(store["visitors"], latest), F.sum("total_visitors")).alias("total_visitors"),
        _scalar(at_latest(store["rooms_beds"], latest), F.sum("total_beds")).alias("total_beds"),
        _scalar(at_latest(store["occupancy"], latest), _mean("average_occupancy_rate")).alias("avg_occupancy"))


def exec_top(store: dict, derived: dict, n: int = 5) -> DataFrame:
    """Top-n regions by score at the latest month *of the score table*."""
    latest = latest_month(derived["scores"])
    p = derived_columns(derived, ["priority_score", "justification_text", "capacity_classification", *COMPONENT_COLS],
                        keep=lambda t: at_latest(t, latest), base="scores")
    return (p.join(store["governorate"].select(G, "governorate_name_en"), G)
            .select(G, "governorate_name_en", "priority_score", "capacity_classification", "justification_text",
                    *COMPONENT_COLS)
            .orderBy(*_score_desc_order()).limit(n))   # top-k: per-partition partial top-k, then merge


# --- OV-7 and UI-derived columns ------------------------------------------------

def map_dataset(boundaries: DataFrame, overview: DataFrame, metric: str = "priority_score",
                name: Column | None = None) -> DataFrame:
    """Boundary features LEFT-joined to overview metrics on the normalised
    region name (duplicate names: the last row in overview order wins), with
    the legend bin of ``metric``.  ``name`` picks the feature name (default:
    ``governorate_name_en``; for GeoJSON files use ``geojson.feature_name``)."""
    order_key = F.struct(F.col("priority_score").isNull().alias("a"),
                         (-F.col("priority_score")).alias("b"), F.col(G).alias("c"))
    metrics = (overview.withColumn("_k", normalize_name(F.col("governorate_name_en")))
               .groupBy("_k").agg(F.max_by(F.struct(*[F.col(c) for c in overview.columns]), order_key).alias("m")))
    name = F.col("governorate_name_en") if name is None else name
    feats = boundaries.withColumn("_name", name).withColumn("_k", normalize_name(F.col("_name")))
    joined = feats.join(metrics, "_k", "left")
    return joined.select(
        F.col(G).alias("feature_governorate_id"),
        F.col("_name").alias("feature_name"),
        F.col(f"m.{G}").alias("metric_governorate_id"),
        F.col(f"m.{metric}").alias("metric_value"),
        C.metric_bin(metric, F.col(f"m.{metric}")).alias("metric_bin"),
    )


def sites_with_coords(sites: DataFrame) -> DataFrame:
    """FLT-6: sites drawn on the map (NULL and 0 coordinates dropped)."""
    return sites.where((F.col("latitude") != 0) & (F.col("longitude") != 0))


def list_sites(sites: DataFrame, governorate_id: int | None = None) -> DataFrame:
    """SRC-22: sites ordered by name; optionally one region's sites."""
    if governorate_id is not None:
        sites = sites.where(F.col(G) == governorate_id)
    return sites.orderBy("site_name_en", "tourism_site_id")


def scaled_series(series: DataFrame, cols=("total_visitors", "priority_score")) -> DataFrame:
    """WN-9: each series scaled by its own maximum (floor 1, NULL -> 0)."""
    w = Window.partitionBy(G)
    out = series
    for c in cols:
        val = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        out = out.withColumn(f"{c}_scaled", val / F.greatest(F.max(val).over(w), F.lit(1.0)))
    return out


def top_per_group(run_rows: DataFrame, n_groups: int = 4, n_rows: int = 4) -> DataFrame:
    """WN-5: first ``n_rows`` months of the first ``n_groups`` region names of a
    forecast run detail (rows ordered by region id, month)."""
    firsts = (run_rows.groupBy("governorate_name_en").agg(F.min(G).alias("_first"))
              .orderBy("_first").limit(n_groups))   # top-k, not a global window
    w = Window.partitionBy("governorate_name_en").orderBy(G, "forecast_month")
    return (run_rows.join(F.broadcast(firsts), "governorate_name_en")   # <= n_groups rows
            .withColumn("row_in_group", F.row_number().over(w))
            .where(F.col("row_in_group") <= n_rows)
            .drop("_first"))


def display_percent(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """PRJ-14 as a column."""
    return df.withColumn(name or f"{col}_pct", C.percent(col))
