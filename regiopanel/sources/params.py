"""System parameters: numeric map (lenient parse) and keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiopanel import schemas as S


def seed_params(spark: SparkSession) -> DataFrame:
    rows = [(k, v, "number", d, None) for k, v, d in S.SEED_PARAMS]
    return spark.createDataFrame(rows, S.PARAMS)


def numeric_params(params: DataFrame) -> DataFrame:
    """(parameter_key, value double), silently dropping non-numeric values."""
    return (params.select("parameter_key", F.col("parameter_value").try_cast("double").alias("value"))
            .where(F.col("value").isNotNull()))


def numeric_map_column(params: DataFrame) -> DataFrame:
    """One row with a MAP<string,double> of the numeric parameters."""
    return numeric_params(params).agg(
        F.map_from_entries(F.collect_list(F.struct("parameter_key", "value"))).alias("params"))


def resolve(params: DataFrame | None, overrides: dict | None = None) -> dict:
    """Scalar parameters for a job: defaults, replaced by the table's numeric values
    for the same keys, replaced by explicit overrides.  Only the known keys reach the
    driver."""
    out = dict(S.DEFAULT_PARAMS)
    out[S.HIGH_PRIORITY_KEY] = None
    if params is not None:
        for r in numeric_params(params.where(F.col("parameter_key").isin(list(out)))).collect():
            out[r["parameter_key"]] = r["value"]
    out.update(overrides or {})
    return out


def upsert_params(base: DataFrame, updates: DataFrame) -> DataFrame:
    """Keyed upsert of parameter rows.

    ``updates`` has parameter_key, parameter_value and optionally value_type,
    description and ``update_seq`` (order of application; the last update of a
    key wins).  value_type defaults to 'number'; a NULL description keeps the
    old one; updated rows get the current timestamp.
    """
    u = updates
    for name, default in (("value_type", F.lit(None).cast("string")),
                          ("description", F.lit(None).cast("string")),
                          ("update_seq", F.monotonically_increasing_id())):
        if name not in u.columns:
            u = u.withColumn(name, default)
    # Last update per key wins; a key's updates are few, but use an aggregate
    # (partial, combinable) rather than a window so a hot key cannot pile up.
    # Items apply in order: value and type come from the last update; the
    # description from the last update that has one (COALESCE(new, existing)
    # applied item by item), else the stored one.
    last = (u.groupBy("parameter_key")
            .agg(F.max_by(F.struct(F.col("parameter_value").cast("string").alias("v"),
                                   F.coalesce("value_type", F.lit("number")).alias("t")), "update_seq").alias("u"),
                 F.max_by("description", F.when(F.col("description").isNotNull(), F.col("update_seq")))
                 .alias("d")))
    joined = base.alias("b").join(last.alias("n"), "parameter_key", "full_outer")
    return joined.select(
        "parameter_key",
        F.coalesce(F.col("n.u.v"), F.col("b.parameter_value")).alias("parameter_value"),
        F.coalesce(F.col("n.u.t"), F.col("b.value_type")).alias("value_type"),
        F.coalesce(F.col("n.d"), F.col("b.description")).alias("description"),
        F.when(F.col("n.u").isNotNull(), F.current_timestamp()).otherwise(F.col("b.updated_at"))
        .alias("updated_at"),
    )


def list_params(params: DataFrame) -> DataFrame:
    return params.orderBy("parameter_key")



def updates_frame(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Parameter updates from request-style items (parameter_key,
    parameter_value, optional value_type / description), in given order."""
    rows = [(str(it["parameter_key"]), str(it["parameter_value"]), it.get("value_type"), it.get("description"), i)
            for i, it in enumerate(items)]
    return spark.createDataFrame(rows, "parameter_key string, parameter_value string, value_type string, "
                                       "description string, update_seq long")
