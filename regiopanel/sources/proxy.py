"""Panel store derived from the TPC-H-style driver tables.

The driver has no tourism data, so the panel is a *stand-in* derived from its
star schema (this mapping is our own design choice):

* region dimension   <- ``nation``
* visitors (demand)  <- ``orders`` x ``customer``: per customer nation and order
  month, 0.1 % of the summed order value
* rooms / beds       <- ``lineitem`` x ``supplier``: per supplier nation and ship
  month, line count and summed quantity
* occupancy          <- same join: mean discount x 10
  (a fraction in 0..1), rounded half-up to 4 dp with exact integer arithmetic
* sites              <- ``supplier`` rows, coordinates from the key
* boundaries         <- one WKT rectangle per nation, parsed by the import path

Scale notes.  The heavy work is scan + join + aggregate of the two fact
tables.  The two aggregates are cached: they are panel-sized (regions x
months, independent of the raw volume) and every downstream operator reads
them several times, so each raw table is scanned once per session.  Only the
needed columns are read (column pruning reaches the Parquet scan).
The dimension sides (``customer``, ``supplier``) are joined on their keys; Spark
broadcasts them only when its size estimate, or AQE's measured shuffle size,
is under the broadcast threshold, and otherwise uses a sort-merge join whose
skewed partitions (a hot customer/supplier) AQE splits.  The group-by on
(nation, month) runs a map-side partial aggregate, so hot groups are combined
before the shuffle and the shuffle carries at most one row per group per task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiopanel import schemas as S

G, M = S.G, S.M


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(prefix: str, key: F.Column) -> F.Column:
    """Prefix and key, keys of one digit padded to two; longer ones stay whole."""
    text = key.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))


def governorates(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("int").alias(G),
        _code("N", F.col("n_nationkey")).alias("governorate_code"),
        F.col("n_name").alias("governorate_name_en"),
        F.lit(None).cast("string").alias("governorate_name_ar"),
    )


def visitors(orders: DataFrame, customer: DataFrame) -> DataFrame:
    o = orders.select("o_custkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias(M),
                      F.col("o_totalprice").cast(S.MONEY).alias("price"))
    c = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias(G))
    return (o.join(c, "o_custkey")
            .groupBy(G, M)
            .agg((F.sum("price") * F.lit(Decimal("0.001"))).cast(S.MONEY).alias("total_visitors"))
            .cache())   # panel-sized; reused by every downstream operator


def _supplier_lines(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    li = lineitem.select("l_suppkey", "l_quantity", "l_discount",
                         F.trunc(F.col("l_shipdate").cast("date"), "month").alias(M))
    s = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("int").alias(G))
    return li.join(s, "l_suppkey")


def rooms_beds_and_occupancy(lineitem: DataFrame, supplier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both capacity facts from ONE scan/join/aggregate of lineitem."""
    cents = F.round(F.col("l_discount") * 100).cast("long")
    agg = (_supplier_lines(lineitem, supplier)
           .groupBy(G, M)
           .agg(F.count(F.lit(1)).alias("n_lines"),
                F.sum("l_quantity").alias("qty"),
                F.sum(cents).alias("occ_cents"),
                F.count(cents).alias("occ_n"))
           .cache())   # one lineitem pass feeds both facts (pruning would otherwise split it)
    rb = agg.select(G, M, F.col("n_lines").cast(S.MONEY).alias("total_rooms"),
                    F.col("qty").cast(S.MONEY).alias("total_beds"))
    # mean(discount) * 10 = occ_cents / (10 * occ_n); x 10^4 rounded half-up
    # = (2000 * occ_cents + occ_n) div (2 * occ_n), exact in integers.
    e4 = F.expr("(occ_cents * 2000 + occ_n) div (2 * occ_n)")
    occ = (agg.where(F.col("occ_n") > 0)
           .select(G, M, (e4.cast("decimal(12,0)") * F.lit(Decimal("0.0001"))).cast(S.RATE)
                   .alias("average_occupancy_rate")))
    return rb, occ


def sites(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("tourism_site_id"),
        F.col("s_name").alias("site_name_en"),
        F.concat(F.lit("category_"), (k % 4).cast("string")).alias("site_category"),
        F.col("s_nationkey").cast("int").alias(G),
        (F.lit(29.0) + (k % 400).cast("double") / 100).cast(S.SITES["latitude"].dataType).alias("latitude"),
        (F.lit(35.0) + (k % 200).cast("double") / 100).cast(S.SITES["longitude"].dataType).alias("longitude"),
    )


def rectangle_wkt(df: DataFrame, key: str, code_prefix: str, name: str) -> DataFrame:
    """One WKT rectangle per row (a grid cell from the key), as raw
    boundary-import strings (id, code, name, wkt)."""
    k = F.col(key)
    x0 = (F.lit(30.0) + (k % 5).cast("double"))
    y0 = (F.lit(25.0) + (k / 5).cast("long").cast("double") * 0.01)
    pt = lambda x, y: F.format_string("%.2f %.2f", x, y)
    ring = F.concat_ws(",", pt(x0, y0 + 0.8), pt(x0 + 0.8, y0 + 0.8), pt(x0 + 0.8, y0), pt(x0, y0), pt(x0, y0 + 0.8))
    return df.select(
        k.cast("string").alias(G),
        _code(code_prefix, k).alias("governorate_code"),
        F.col(name).alias("governorate_name_en"),
        F.concat(F.lit("POLYGON(("), ring, F.lit("))")).alias("wkt"),
    )


def boundary_wkt(nation: DataFrame) -> DataFrame:
    """One WKT rectangle per nation."""
    return rectangle_wkt(nation, "n_nationkey", "N", "n_name")


def nested_wkt(customer: DataFrame) -> DataFrame:
    """Per customer a MULTIPOLYGON of two squares, the first with a hole, on a grid of
    whole coordinates.  By the key some holes lie outside, some rings are open, have too
    few points or no area, and some rings run the other way round."""
    k = F.col("c_custkey")
    x, y = (k % 180) - 90, (k % 80) - 40
    pt = lambda dx, dy: F.concat_ws(" ", (x + dx).cast("string"), (y + dy).cast("string"))

    def ring(*points):
        return F.concat(F.lit("("), F.concat_ws(", ", *[pt(a, b) for a, b in points]), F.lit(")"))
    square = lambda a, b, n: ((a, b), (a + n, b), (a + n, b + n), (a, b + n), (a, b))
    shell = F.when(k % 11 == 4, ring(*square(0, 0, 8)[:4])).when(k % 11 == 5, ring((0, 0), (8, 0), (0, 0))) \
        .when(k % 11 == 6, ring((0, 0), (4, 4), (8, 8), (0, 0))).when(k % 2 == 0, ring(*square(0, 0, 8)[::-1])).otherwise(ring(*square(0, 0, 8)))
    hole = F.when(k % 11 == 7, ring(*square(6, 6, 5))).otherwise(ring(*square(1, 2, 3)))
    return customer.select(
        k.cast("string").alias(G), F.concat(F.lit("C"), k.cast("string")).alias("governorate_code"), F.col("c_name").alias("governorate_name_en"),
        F.concat(F.lit("MULTIPOLYGON(("), shell, F.lit(", "), hole, F.lit("), ("), ring(*square(20, 0, 2)), F.lit("))")).alias("wkt"))


def customer_regions(customer: DataFrame) -> DataFrame:
    """A region dimension with one region per customer (grows with the data).
    The key stays BIGINT: customer keys outgrow INTEGER at very large scale."""
    return customer.select(F.col("c_custkey").alias(G),
                           F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("governorate_code"),
                           F.col("c_name").alias("governorate_name_en"),
                           F.lit(None).cast("string").alias("governorate_name_ar"))


# --- a second panel, in which every branch of the operators occurs -----------------

def _members(customer: DataFrame) -> DataFrame:
    """(custkey, region, n_months): a customer counts in its nation, in its market
    segment (100 + the letter's code), in a group of nations (500 + nation % 7), in the
    whole (600) and in one of 20 regions (300 + custkey % 20) that have 1 to 20 months of
    history."""
    nation, key = F.col("c_nationkey").cast("int"), F.col("c_custkey")
    late = (key % 20).cast("int")
    pair = lambda g, n: F.struct(g.alias(G), n.alias("n_months"))
    all_ = F.lit(None).cast("int")
    return customer.select(key.alias("o_custkey"), F.inline(F.array(
        pair(nation, all_), pair(F.ascii(F.substring("c_mktsegment", 1, 1)) + 100, all_), pair(nation % 7 + 500, all_),
        pair(late + 300, late + 1), pair(F.lit(600), all_))))


def varied_facts(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """(region, month, days, orders): the days with an order and the orders, for all
    months but the last, which is not complete; of a region that opened late only its
    last months."""
    day = F.col("o_orderdate").cast("date")
    end = orders.agg(F.trunc(F.max(day), "month")).scalar()
    per_day = orders.where(day < end).select("o_custkey", day.alias("day")).groupBy("o_custkey", "day") \
        .agg(F.count(F.lit(1)).alias("n")).join(_members(customer), "o_custkey") \
        .where(F.col("n_months").isNull() | (F.col("day") >= F.add_months(end, -F.col("n_months")))) \
        .groupBy(G, "day").agg(F.sum("n").alias("n"))
    return per_day.groupBy(G, F.trunc("day", "month").alias(M)).agg(
        F.count(F.lit(1)).alias("days"), F.sum("n").alias("orders")).cache()   # panel-sized


def varied_names(region: F.Column) -> F.Column:
    """Region names with accents, ligatures and quotes."""
    prefixes = F.array(*map(F.lit, ["Région ", "Örtlichkeit d'", "SÃO ", "ﬁn L`Île №", "Łódź–"]))
    return F.concat(F.element_at(prefixes, (region % 5 + 1).cast("int")), region.cast("string"))


def varied_store(spark: SparkSession, sf_dir: str) -> dict:
    """A panel over the same tables in which regions have short, long, smooth and noisy
    series, missing capacity, missing occupancy, accented names and sites without
    coordinates."""
    from regiopanel.sources.params import seed_params

    t = lambda name: read_table(spark, sf_dir, name)
    facts = varied_facts(t("orders"), t("customer"))
    regions = facts.select(G).distinct()
    name = varied_names(F.col(G))
    beds_each = F.element_at(F.array(*map(F.lit, [2, 300, 400, 600, 10000])), (F.col(G) % 5 + 1).cast("int"))
    rate = F.expr("(2 * 10000 * days + day(last_day(month_index))) div (2 * day(last_day(month_index)))")
    sites_ = sites(t("supplier"))
    k = F.col("tourism_site_id")
    return {
        "governorate": regions.select(G, _code("V", F.col(G)).alias("governorate_code"), name.alias("governorate_name_en"),
                                      F.lit(None).cast("string").alias("governorate_name_ar")),
        "visitors": facts.select(G, M, (F.col("days") * 5000).cast(S.MONEY).alias("total_visitors")),
        "rooms_beds": facts.where(F.col(G) % 7 != 3).select(
            G, M, F.col("orders").cast(S.MONEY).alias("total_rooms"), (F.col("orders") * beds_each).cast(S.MONEY).alias("total_beds")),
        "occupancy": facts.where(F.col(G) % 6 != 5).select(
            G, M, (rate.cast("decimal(12,0)") * F.lit(Decimal("0.0001"))).cast(S.RATE).alias("average_occupancy_rate")),
        "sites": sites_.withColumns({"latitude": F.when(k % 10 != 0, F.col("latitude")).otherwise(F.lit(0).cast(S.SITES["latitude"].dataType)),
                                     "longitude": F.when(k % 11 != 0, F.col("longitude"))}),
        # the boundary file spells the names otherwise
        "boundaries": regions.select(G, F.concat(F.lit("b"), F.col(G).cast("string")).alias("governorate_code"),
                                     F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("__")), F.lit("'"), F.lit("`")).alias("governorate_name_en")),
        "params": seed_params(spark),
    }


def part_series(lineitem: DataFrame) -> DataFrame:
    """One series per part: the value shipped in each month.  The number of series grows
    with the data, and some are short.  (Quantities are small whole numbers, so the bands
    of their forecasts often end exactly on half a cent, where the last bit decides.)"""
    return lineitem.groupBy(F.col("l_partkey").alias(G), F.trunc(F.col("l_shipdate").cast("date"), "month").alias(M)) \
        .agg(F.sum(F.col("l_extendedprice").cast(S.MONEY)).cast(S.MONEY).alias("total_visitors"))


def panel_store(spark: SparkSession, sf_dir: str) -> dict:
    """Facts, dimension, sites, boundaries and default parameters."""
    from regiopanel.sources.params import seed_params
    from regiopanel.sources.ingest import parse_boundaries

    t = lambda name: read_table(spark, sf_dir, name)
    nation = t("nation")
    rb, occ = rooms_beds_and_occupancy(t("lineitem"), t("supplier"))
    return {
        "governorate": governorates(nation),
        "visitors": visitors(t("orders"), t("customer")),
        "rooms_beds": rb,
        "occupancy": occ,
        "sites": sites(t("supplier")),
        "boundaries": parse_boundaries(boundary_wkt(nation)),
        "params": seed_params(spark),
    }
