"""Ring checks against plain Python."""
import random

from pyspark.sql import functions as F

from regiopanel.functions import geo


def area(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2


def inside(p, r):
    hits = 0
    for a, b in zip(r, r[1:]):
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]):
            hits += 1
    return hits % 2 == 1


def test_area_and_inside(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        pts = [[rng.randrange(-9, 9), rng.randrange(-9, 9)] for _ in range(rng.randrange(3, 9))]
        rows.append(([[float(x), float(y)] for x, y in [*pts, pts[0]]], [rng.uniform(-10, 10), rng.uniform(-10, 10)]))
    df = spark.createDataFrame(rows, "r array<array<double>>, p array<double>")
    for r in df.select("r", "p", geo.signed_area(F.col("r")).alias("a"), geo.inside(F.col("p"), F.col("r")).alias("i")).collect():
        assert r.a == area(r.r) and r.i == inside(r.p, r.r)


def test_reasons(spark):
    wkt = {
        "POLYGON((0 0, 4 0, 4 4, 0 0))": None,
        "POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 1))": None,
        "polygon((0 0, 0 9, 9 9, 9 0, 0 0), (1 1, 1 2, 2 2, 1 1))": None,
        "POLYGON((0 0, 4 0, 4 4))": "a ring has fewer than 4 points",
        "POLYGON((0 0, 4 0, 4 4, 0 1))": "a ring is not closed",
        "POLYGON((0 0, 1 1, 2 2, 0 0))": "a ring has no area",
        "POLYGON((0 0, 4 0, 4 4, 0 0), (5 5, 6 5, 6 6, 5 5))": "a hole lies outside its shell",
        "MULTIPOLYGON(((0 0, 4 0, 4 4, 0 0)), ((9 9, 8 9, 8 8, 9 9), (8.9 8.8, 8.8 8.8, 8.9 8.9, 8.9 8.8)))": "a hole lies outside its shell",
        "MULTIPOLYGON(((0 0, 4 0, 4 4, 0 0)), ((9 9, 8 9, 8 8, 9 9), (8.4 8.6, 8.5 8.6, 8.5 8.7, 8.4 8.6)))": None,
        "POINT(1 2)": "invalid WKT multipolygon", "": "invalid WKT multipolygon", None: "invalid WKT multipolygon",
    }
    df = spark.createDataFrame([(w,) for w in wkt], "w string").withColumn("g", geo.wkt_to_multipolygon(F.col("w")))
    got = df.select("w", F.when(F.col("g").isNull(), geo.wkt_problem(F.col("w"))).otherwise(geo.ring_problem(F.col("g"))).alias("m"),
                    geo.covered_area(F.col("g")).alias("a"))
    rows = {r.w: r for r in got.collect()}
    assert {w: r.m for w, r in rows.items()} == wkt
    assert rows["POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 1))"].a == 80.5


def test_boundaries_are_read_once(spark):
    """However many rules look at a geometry, the plan works it out in one place."""
    from regiopanel.sources import ingest
    raw = spark.createDataFrame([("1", "N1", "a", "POLYGON((0 0, 4 0, 4 4, 0 0))"), ("2", "N2", "b", "POLYGON((0 0, 4 0, 4 4))")],
                                "governorate_id string, governorate_code string, governorate_name_en string, wkt string")
    loaded = ingest.parse_boundaries(raw.withColumn("wkt", F.concat("wkt", F.lit(""))))
    assert loaded._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= 3  # polygons, rings of both kinds
    assert [r.governorate_id for r in loaded.collect()] == [1]
