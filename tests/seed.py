"""Synthetic seed panel (SRC-16) for any region dimension.

Per region and month index i (0..n-1, months from ``start``): visitors =
(30000 + 7000 id) x month factor x (1 + 0.01 i) x region multiplier; rooms =
(900 + 120 id) x multiplier, beds = (900 + 120 id) x 2.1 x multiplier;
occupancy = clamp(visitors / (beds x 35), 0.25, 0.92).  Exact decimal
arithmetic, rounded like the stored NUMERIC columns.  Months are generated
per region with ``explode(sequence)`` -- no cartesian join.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regiopanel import schemas as S
from regiopanel.functions.columns import store_as

G, M = S.G, S.M

# Fixed seed values.
MONTH_FACTORS = ["0.80", "0.85", "0.95", "1.05", "1.10", "1.20", "1.28", "1.25", "1.05", "1.00", "0.92", "0.88"]
VISITOR_MULTIPLIER = {"AQA": "1.25", "MAA": "1.35", "AMM": "1.50"}
CAPACITY_MULTIPLIER = {"AQA": "1.45", "AMM": "1.60"}
SEED_REGIONS = [
    (1, "AMM", "Amman"), (2, "AQA", "Aqaba"), (3, "BAL", "Balqa"), (4, "IRB", "Irbid"),
    (5, "JER", "Jerash"), (6, "KAR", "Karak"), (7, "MAA", "Ma'an"), (8, "MAD", "Madaba"),
    (9, "MAF", "Mafraq"), (10, "TAF", "Tafilah"), (11, "AJL", "Ajloun"), (12, "ZAR", "Zarqa"),
]
# Region boundaries as WKT.
SEED_WKT = {
    1: "POLYGON((35.80 31.80,36.20 31.80,36.20 31.40,35.80 31.40,35.80 31.80))",
    2: "POLYGON((35.00 29.80,35.30 29.80,35.30 29.30,35.00 29.30,35.00 29.80))",
    3: "POLYGON((35.40 32.00,35.80 32.00,35.80 31.60,35.40 31.60,35.40 32.00))",
    4: "POLYGON((35.70 32.20,36.20 32.20,36.20 31.95,35.70 31.95,35.70 32.20))",
    5: "POLYGON((35.70 32.00,36.05 32.00,36.05 31.75,35.70 31.75,35.70 32.00))",
    6: "POLYGON((35.40 31.40,35.95 31.40,35.95 30.95,35.40 30.95,35.40 31.40))",
    7: "POLYGON((35.10 30.80,36.10 30.80,36.10 29.80,35.10 29.80,35.10 30.80))",
    8: "POLYGON((35.50 31.80,35.90 31.80,35.90 31.40,35.50 31.40,35.50 31.80))",
    9: "POLYGON((36.00 32.30,37.50 32.30,37.50 31.70,36.00 31.70,36.00 32.30))",
    10: "POLYGON((35.20 31.20,35.60 31.20,35.60 30.80,35.20 30.80,35.20 31.20))",
    11: "POLYGON((35.60 32.10,35.90 32.10,35.90 31.90,35.60 31.90,35.60 32.10))",
    12: "POLYGON((36.00 32.00,36.60 32.00,36.60 31.50,36.00 31.50,36.00 32.00))",
}
SEED_SITES = [
    ("Petra Archaeological Park", "cultural", 7, "30.3285", "35.4444"),
    ("Wadi Rum Protected Area", "nature", 7, "29.5721", "35.4200"),
    ("Aqaba Waterfront", "coastal", 2, "29.5319", "35.0061"),
    ("Dead Sea Resort Zone", "resort", 8, "31.7185", "35.5900"),
    ("Jerash Archaeological Site", "cultural", 5, "32.2808", "35.8993"),
    ("Amman Citadel", "cultural", 1, "31.9545", "35.9340"),
    ("Karak Castle", "cultural", 6, "31.1808", "35.7022"),
]


def seed_governorates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, n, None) for i, c, n in SEED_REGIONS], S.GOVERNORATE)


def seed_sites(spark: SparkSession) -> DataFrame:
    rows = [(k + 1, n, c, g, Decimal(la), Decimal(lo)) for k, (n, c, g, la, lo) in enumerate(SEED_SITES)]
    return spark.createDataFrame(rows, S.SITES)


def _by_code(code, table: dict) -> F.Column:
    expr = F.lit(Decimal("1"))
    for k, v in table.items():
        expr = F.when(code == k, F.lit(Decimal(v))).otherwise(expr)
    return expr


def seed_panel(governorate: DataFrame, n_months: int = 24, start: str = "2024-01-01") -> dict:
    """Visitors, rooms/beds and occupancy facts for every region of ``governorate``."""
    factors = F.array(*[F.lit(Decimal(f)) for f in MONTH_FACTORS])
    g = governorate.select(G, "governorate_code")
    rows = (g.select(G, "governorate_code", F.explode(F.sequence(F.lit(0), F.lit(n_months - 1))).alias("i"))
            .withColumn(M, F.add_months(F.lit(start).cast("date"), F.col("i"))))
    gid = F.col(G).cast("decimal(20,0)")
    factor = F.element_at(factors, F.month(M))
    visitors = ((F.lit(Decimal("30000")) + gid * 7000) * factor
                * (F.lit(Decimal("1")) + F.col("i").cast("decimal(10,0)") * F.lit(Decimal("0.01")))
                * _by_code(F.col("governorate_code"), VISITOR_MULTIPLIER))
    cap = _by_code(F.col("governorate_code"), CAPACITY_MULTIPLIER)
    rooms = (F.lit(Decimal("900")) + gid * 120) * cap
    beds = (F.lit(Decimal("900")) + gid * 120) * F.lit(Decimal("2.1")) * cap
    ratio = visitors.cast("double") / (beds.cast("double") * 35.0)
    occ = F.least(F.lit(0.92), F.greatest(F.lit(0.25), ratio))
    facts = rows.select(G, M, store_as(F.round(visitors, 2), S.MONEY).alias("total_visitors"),
                        store_as(F.round(rooms, 2), S.MONEY).alias("total_rooms"),
                        store_as(F.round(beds, 2), S.MONEY).alias("total_beds"),
                        store_as(F.round(occ, 4), S.RATE).alias("average_occupancy_rate"))
    return {"visitors": facts.select(G, M, "total_visitors"),
            "rooms_beds": facts.select(G, M, "total_rooms", "total_beds"),
            "occupancy": facts.select(G, M, "average_occupancy_rate"),
            "facts": facts}


def seed_store(spark: SparkSession) -> dict:
    """The reference's sample deployment: 12 regions x 24 months, parameters,
    sites and rectangle boundaries."""
    from regiopanel.sources.ingest import parse_boundaries
    from regiopanel.sources.params import seed_params
    gov = seed_governorates(spark)
    panel = seed_panel(gov)
    wkt_rows = [(str(i), code, name, SEED_WKT[i]) for i, code, name in SEED_REGIONS]
    raw = spark.createDataFrame(wkt_rows, "governorate_id string, governorate_code string, "
                                          "governorate_name_en string, wkt string")
    return {"governorate": gov, "visitors": panel["visitors"], "rooms_beds": panel["rooms_beds"],
            "occupancy": panel["occupancy"], "sites": seed_sites(spark),
            "boundaries": parse_boundaries(raw), "params": seed_params(spark)}
