"""Export datasets and writers (SRC-17, SRC-18, SRC-19).

Writers are distributed: CSV parts per task, one GeoJSON feature per line
(RFC 8142 text sequence) instead of one FeatureCollection string, so no
single task or the driver ever holds the whole export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regiopanel import schemas as S
from regiopanel.functions.geo import geojson_geometry
from regiopanel.operators.indicators import derived_columns, next_forecast_per_region
from regiopanel.operators.overview import at_latest, latest_month

G, M = S.G, S.M

# Export column headers, in output order.
OVERVIEW_HEADERS = [("governorate_name_en", "Governorate"), ("latest_total_visitors", "Visitors"),
                    ("latest_total_beds", "Beds"), ("latest_average_occupancy_rate", "Occupancy Rate"),
                    ("priority_score", "Priority Score"), ("capacity_classification", "Capacity Classification"),
                    ("next_forecast_value", "Next Forecast"), ("justification_text", "Justification")]
REGION_HEADERS = [(M, "Month"), ("total_visitors", "Visitors"), ("total_rooms", "Rooms"), ("total_beds", "Beds"),
                  ("average_occupancy_rate", "Occupancy Rate"), ("priority_score", "Priority Score")]


def overview_export(store: dict, derived: dict) -> DataFrame:
    """SRC-17: latest-month overview, 8 renamed columns, ordered by region id."""
    latest = latest_month(store["visitors"])
    base = store["governorate"].select(G, "governorate_name_en").withColumn(M, latest)
    v = at_latest(store["visitors"], latest).select(G, M, F.col("total_visitors").alias("latest_total_visitors"))
    rb = at_latest(store["rooms_beds"], latest).select(G, M, F.col("total_beds").alias("latest_total_beds"))
    o = at_latest(store["occupancy"], latest).select(
        G, M, F.col("average_occupancy_rate").alias("latest_average_occupancy_rate"))
    d = derived_columns(derived, ["priority_score", "justification_text", "capacity_classification"],
                        keep=lambda t: at_latest(t, latest))
    df = (base.join(v, [G, M], "left").join(rb, [G, M], "left").join(o, [G, M], "left")
          .join(d, [G, M], "left"))
    if store.get("model_run") is not None and store.get("forecast") is not None:
        fc = next_forecast_per_region(store["model_run"], store["forecast"]).select(
            G, F.col("forecast_value").alias("next_forecast_value"))
        df = df.join(fc, G, "left")
    else:
        df = df.withColumn("next_forecast_value", F.lit(None).cast(S.MONEY))
    return df.orderBy(G).select(G, *[F.col(a).alias(b) for a, b in OVERVIEW_HEADERS])


def region_export(store: dict, scores: DataFrame, governorate_id: int | None = None) -> DataFrame:
    """SRC-18: per-region series with 6 renamed columns (+ region id for
    partitioned writing), ordered by region and month."""
    from regiopanel.operators.overview import region_series
    s = region_series(store, scores, governorate_id)
    return s.select(G, *[F.col(a).alias(b) for a, b in REGION_HEADERS])


def geojson_features(boundaries: DataFrame) -> DataFrame:
    """SRC-19: one GeoJSON Feature (JSON text) per boundary, ordered by id."""
    feat = F.struct(F.lit("Feature").alias("type"), geojson_geometry(F.col("boundary_coords")).alias("geometry"),
                    F.struct(G, "governorate_code", "governorate_name_en").alias("properties"))
    return boundaries.select(G, F.to_json(feat).alias("feature_json")).orderBy(G)


def write_feature_collection(boundaries: DataFrame, path: str) -> None:
    """SRC-19 as one FeatureCollection document: part files that, concatenated in
    name order, are the document (no boundaries -> ``"features":[]``).  Features are
    range-sorted by region id, so no task holds the whole."""
    feats = geojson_features(boundaries)
    first = feats.agg(F.min(G).alias("_first"))                            # one row
    lines = feats.join(first).select(
        F.lit(1).alias("_part"), G, F.when(F.col(G) > F.col("_first"), F.concat(F.lit(","), "feature_json"))
        .otherwise(F.col("feature_json")).alias("value"))
    ends = boundaries.sparkSession.createDataFrame(
        [(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "_part int, value string")
    (lines.unionByName(ends.withColumn(G, F.lit(None).cast(boundaries.schema[G].dataType)))
     .orderBy("_part", G).select("value").write.mode("overwrite").text(path))


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """CSV as in RFC 4180: quotes doubled, text as it is, no trimming."""
    w = (df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


REGION_BUCKETS = 256


def write_region_csvs(store: dict, scores: DataFrame, path: str, buckets: int = REGION_BUCKETS) -> None:
    """All regions' series exports in one write.  Folders are hash buckets of the
    region id, a bounded number; within a bucket rows are sorted by region and month."""
    bucket = F.pmod(F.xxhash64(G), F.lit(buckets)).cast("int").alias("region_bucket")
    df = region_export(store, scores).select("*", bucket)
    write_csv(df.hint("rebalance", "region_bucket").sortWithinPartitions("region_bucket", G, "Month"), path,
              partition_by="region_bucket")


def write_geojson_seq(boundaries: DataFrame, path: str) -> None:
    geojson_features(boundaries).select("feature_json").write.mode("overwrite").text(path)
