"""Column-expression builders.  All are built-in Spark expressions, so they stay
inside whole-stage codegen; none runs Python per row."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from regiopanel import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def store_as(col, dtype) -> Column:
    """Assignment to a NUMERIC(p,s) column: HALF_UP rounding to the scale.  A value
    that doesn't fit fails the job, as a stored NULL would rank a region by nothing."""
    stored = _c(col).try_cast(dtype)
    too_big = F.concat(F.lit(f"numeric field overflow, {dtype.simpleString()}: "), _c(col).cast("string"))
    return F.when(_c(col).isNotNull() & stored.isNull(), F.raise_error(too_big).cast(dtype)).otherwise(stored)


def pg_round(x, scale: int = 2) -> Column:
    """ROUND(float8::numeric, n): the double is first converted with 15
    significant digits, then rounded half away from zero."""
    as_text = F.format_string("%.14e", _c(x))
    return F.round(as_text.try_cast("decimal(38,18)"), scale)


# --- indicators (stored at 4 dp) -------------------------------------------

def visitors_per_1000_beds(v="total_visitors", beds="total_beds") -> Column:
    v, beds = _c(v), _c(beds)
    return F.when(F.coalesce(beds, F.lit(0)) > 0, v / beds * 1000)


def occupancy_pressure(occ="average_occupancy_rate") -> Column:
    # Missing occupancy counts as 0, never NULL.
    return F.coalesce(_c(occ), F.lit(Decimal("0"))) * 100


def growth_pressure(v="total_visitors", prev="prev_total_visitors") -> Column:
    v, prev = _c(v), _c(prev)
    return F.when(prev.isNotNull() & (prev != 0), (v - prev) / prev * 100)


def capacity_adequacy(v="total_visitors", beds="total_beds") -> Column:
    v, beds = _c(v), _c(beds)
    return F.when(F.coalesce(v, F.lit(0)) > 0, beds / v * 1000)


def forecast_pressure(fc="next_forecast_value", beds="total_beds") -> Column:
    fc, beds = _c(fc), _c(beds)
    return F.when((beds > 0) & fc.isNotNull(), F.least(F.lit(Decimal("100")), fc / beds * 4))


# --- classification, score components ---------------------------------------

def classify(pressure, tight: float, balanced: float) -> Column:
    p = _c(pressure).cast("double")
    return (F.when(p >= F.lit(float(tight)), F.lit(S.UNDER))
            .when(p >= F.lit(float(balanced)), F.lit(S.BALANCED))
            .otherwise(F.lit(S.OVER)))


def justification(cls) -> Column:
    c = _c(cls)
    return (F.when(c == S.UNDER, F.lit(S.JUSTIFICATION[S.UNDER]))
            .when(c == S.BALANCED, F.lit(S.JUSTIFICATION[S.BALANCED]))
            .otherwise(F.lit(S.JUSTIFICATION[S.OVER])))


def raw_components(params: dict, occ="occupancy_pressure_index", growth="growth_pressure_index",
                   vpb="visitors_per_1000_beds", fp="forecast_pressure_index") -> list[Column]:
    """The four unrounded weighted components (double), in score order.

    Inputs are the stored 4-dp indicators; the decimal part (coalesce, /25,
    least/greatest) is exact, the weights are doubles as in the reference.
    """
    zero, hundred = F.lit(Decimal("0")), F.lit(Decimal("100"))
    c_occ = F.coalesce(_c(occ), zero).cast("double") * F.lit(params["priority_weight_occupancy"])
    c_gr = (F.least(F.greatest(F.coalesce(_c(growth), zero), zero), hundred).cast("double")
            * F.lit(params["priority_weight_growth"]))
    c_vpb = (F.least(F.coalesce(_c(vpb), zero) / 25, hundred).cast("double")
             * F.lit(params["priority_weight_visitor_bed"]))
    c_fc = F.least(F.coalesce(_c(fp), zero), hundred).cast("double") * F.lit(params["priority_weight_forecast"])
    return [c_occ, c_gr, c_vpb, c_fc]


def priority_score(components: list[Column]) -> Column:
    """round(least(100, sum of the *unrounded* components), 2)."""
    total = components[0] + components[1] + components[2] + components[3]
    return pg_round(F.least(F.lit(100.0), total), 2)


# --- forecasting ------------------------------------------------------------

def reliability(n, mape) -> Column:
    n, mape = _c(n), _c(mape)
    expr = None
    for min_n, max_mape, label in S.RELIABILITY:
        cond = (n >= min_n) & mape.isNotNull() & (mape <= max_mape)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(S.RELIABILITY_ELSE))


def model_name(requested: str | None) -> str:
    return requested if requested in S.MODELS else S.DEFAULT_MODEL


# --- scenario ---------------------------------------------------------------

def recommendation(before, after) -> Column:
    before, after = _c(before), _c(after)
    return (F.when(after < before - S.NOTE_BAND, F.lit(S.NOTE_IMPROVES))
            .when(after > before + S.NOTE_BAND, F.lit(S.NOTE_WORSENS))
            .otherwise(F.lit(S.NOTE_MODEST)))


# --- presentation columns (map legend, names, percentages) ------------------

def metric_bin(metric: str, value) -> Column:
    """Legend bin label of ``value`` for one of the map metrics."""
    v = _c(value)
    if metric == S.CLASS_METRIC:
        return F.when(v.isNull() | (v == ""), F.lit(S.NO_DATA)).otherwise(v)
    bins = S.METRIC_BINS[metric]
    d = v.cast("double")
    expr = F.when(d.isNull(), F.lit(S.NO_DATA))
    for edge, label in bins:
        expr = expr.when(d >= F.lit(float(edge)), F.lit(label)) if edge is not None else expr.otherwise(F.lit(label))
    return expr


def percent(value) -> Column:
    """Fractions (<= 1.5) are scaled x100; larger values are taken as percent."""
    d = _c(value).cast("double")
    return F.round(F.when(d <= S.PERCENT_SCALE_LIMIT, d * 100).otherwise(d), 1)
