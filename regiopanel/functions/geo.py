"""WKT polygon parsing into nested arrays and GeoJSON rendering, as built-in
column expressions (regex extraction + higher-order functions).

Geometry model: MultiPolygon = array<polygon>, polygon = array<ring>,
ring = array<point>, point = array<double>(lon, lat).  A single POLYGON is
promoted to a one-element MultiPolygon.  Anything else -- other geometry
types, unclosed rings or rings with fewer than 4 points -- gives NULL, and
``wkt_problem`` the reason.  ``ring_problem`` looks at the rings of a parsed
geometry: a ring without area, or a hole that is not inside its shell.  All of it
is array functions; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_PT = rf"{_NUM}\s+{_NUM}"
_RING = rf"\(\s*{_PT}(?:\s*,\s*{_PT})*\s*\)"
_POLY = rf"\(\s*{_RING}(?:\s*,\s*{_RING})*\s*\)"
_WKT = rf"^\s*(?:POLYGON\s*{_POLY}|MULTIPOLYGON\s*\(\s*{_POLY}(?:\s*,\s*{_POLY})*\s*\))\s*$"


def _ring_points(ring_text: Column) -> Column:
    pts = F.split(F.trim(ring_text), r"\s*,\s*")
    return F.transform(pts, lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda x: x.cast("double")))


def _polygon_rings(poly_text: Column) -> Column:
    rings = F.regexp_extract_all(poly_text, F.lit(r"\(([^()]+)\)"), 1)
    return F.transform(rings, _ring_points)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def _coords(t: Column) -> Column:
    """The rings of an upper-cased text, whatever they are."""
    body = F.regexp_replace(t, r"^\s*(MULTIPOLYGON|POLYGON)\s*", "")

    def rings(body):
        # MULTIPOLYGON body: "((..),(..)),((..))" -> each polygon "(..),(..)"
        polys = F.regexp_extract_all(body, F.lit(rf"\(\s*({_RING}(?:\s*,\s*{_RING})*)\s*\)"), 1)
        return F.when(t.rlike(r"^\s*MULTIPOLYGON"), F.transform(polys, _polygon_rings)).otherwise(F.array(_polygon_rings(body)))
    return _let(body, rings)


def _each_ring(coords: Column, test) -> Column:
    return F.forall(coords, lambda poly: F.forall(poly, test))


def _long_enough(ring: Column) -> Column:
    return F.size(ring) >= 4


def _closed(ring: Column) -> Column:
    return ring[0] == F.element_at(ring, -1)


def wkt_geometry(wkt: Column) -> Column:
    """(geometry, problem) of a text, one of them NULL or, if only ``ring_problem`` finds
    fault, neither.  Each step is worked out once for a text; put a filter on it behind a
    generator (``inline``), or Spark works the whole out again inside the filter."""
    none = lambda why: F.struct(F.lit(None).cast("array<array<array<array<double>>>>").alias("geometry"), F.lit(why).alias("problem"))

    def checked(coords):
        whole = F.when(_each_ring(coords, lambda r: _long_enough(r) & _closed(r)), coords)
        why = F.when(~_each_ring(coords, _long_enough), F.lit("a ring has fewer than 4 points")) \
            .when(~_each_ring(coords, _closed), F.lit("a ring is not closed"))
        return _let(whole, lambda g: F.struct(g.alias("geometry"), F.when(g.isNull(), why).otherwise(ring_problem(g)).alias("problem")))

    return _let(F.upper(F.coalesce(wkt, F.lit(""))), lambda t: F.when(
        ~t.rlike(_WKT), none("invalid WKT multipolygon")).otherwise(_let(_coords(t), checked)))


def wkt_to_multipolygon(wkt: Column) -> Column:
    return wkt_geometry(wkt)["geometry"]


def wkt_problem(wkt: Column) -> Column:
    """Why a text gives no geometry; NULL when it does."""
    return _let(wkt_geometry(wkt), lambda g: F.when(g["geometry"].isNull(), g["problem"]))


def signed_area(ring: Column) -> Column:
    """Area of a closed ring, positive when it runs counter-clockwise."""
    x, y = (lambda i: F.element_at(F.element_at(ring, i), 1)), (lambda i: F.element_at(F.element_at(ring, i), 2))
    steps = F.sequence(F.lit(1), F.size(ring) - 1)
    return F.aggregate(steps, F.lit(0.0), lambda a, i: a + x(i) * y(i + 1) - x(i + 1) * y(i)) / 2


def inside(point: Column, ring: Column) -> Column:
    """Does the point lie inside the closed ring?  (A ray to the right crosses an odd
    number of edges.)"""
    px, py = point[0], point[1]

    def crosses(i):
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        at = a[0] + (py - a[1]) / (b[1] - a[1]) * (b[0] - a[0])
        return F.when(((a[1] > py) != (b[1] > py)) & (px < at), 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0), lambda n, i: n + crosses(i)) % 2 == 1


def ring_problem(coords: Column) -> Column:
    """What is wrong with the rings of a geometry; NULL when nothing is."""
    flat = ~_each_ring(coords, lambda r: signed_area(r) != 0)
    outside = F.exists(coords, lambda poly: F.exists(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))),
                                                     lambda hole: F.exists(hole, lambda p: ~inside(p, poly[0]))))
    return F.when(flat, F.lit("a ring has no area")).when(outside, F.lit("a hole lies outside its shell"))


def covered_area(coords: Column) -> Column:
    """Area of the shells without their holes, whichever way the rings run."""
    of = lambda poly: F.aggregate(poly, F.lit(0.0), lambda a, r: a + F.abs(signed_area(r)))
    return F.aggregate(coords, F.lit(0.0), lambda a, poly: a + 2 * F.abs(signed_area(poly[0])) - of(poly))


def geojson_geometry(coords: Column) -> Column:
    """GeoJSON MultiPolygon object as a struct (render with ``to_json``)."""
    return F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))
