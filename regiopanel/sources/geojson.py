"""GeoJSON boundary sources for the map dataset (JN-11, OV-7).

Reads a FeatureCollection document, or one Feature per line (the format
``sinks.write_geojson_seq`` writes), into (name candidates, geometry as
MultiPolygon coordinates).  Polygon geometries are promoted to MultiPolygon.
A FeatureCollection is one JSON document, so each file is read by one task;
boundary files are dimension-sized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regiopanel import schemas as S

NAME_PROPERTIES = ["name", "NAME_1", "governorate_name_en"]   # first non-empty wins
_GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
_FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", _GEOMETRY),
])
_POLYGON = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))


def _features(df: DataFrame) -> DataFrame:
    g = F.col("f.geometry")
    coords = (F.when(g["type"] == "MultiPolygon", F.from_json(g["coordinates"], S.MULTIPOLYGON))
              .when(g["type"] == "Polygon", F.array(F.from_json(g["coordinates"], _POLYGON))))
    props = F.col("f.properties")
    return df.select(
        props.alias("properties"),
        *[props.getItem(k).alias(f"prop_{k}") for k in NAME_PROPERTIES],
        F.coalesce(props.getItem("governorate_id").try_cast("int"), F.lit(None).cast("int")).alias(S.G),
        coords.alias("boundary_coords"),
    )


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    doc = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(_FEATURE))])
    return _features(spark.read.schema(doc).option("multiLine", True).json(path)
                     .select(F.explode("features").alias("f")))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    return _features(spark.read.schema(_FEATURE).json(path).select(F.struct("*").alias("f")))


def feature_name(df: DataFrame) -> F.Column:
    """The UI's name rule: first non-empty of name, NAME_1, governorate_name_en."""
    return F.coalesce(*[F.nullif(F.col(f"prop_{k}"), F.lit("")) for k in NAME_PROPERTIES], F.lit(""))
