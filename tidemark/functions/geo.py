"""Scalar functions on coordinates; all are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the polar stereographic projection and of the sphere.
DEGREES = 57.29577951
E2 = 6.694379852e-3
EARTH_KM = 6378.137
PI = 3.141592654
SPHERE_KM = 6371.2
MICRORADIANS = 4.8481368169032191  # of one arc second


def clean(x: Column) -> Column:
    """NaN as null: aggregates and comparisons then skip it."""
    return F.nanvl(x, F.lit(None).cast("double"))


def wrap_360(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360).otherwise(lon)


def wrap_180(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).otherwise(lon)


def _conformal(lat: Column) -> Column:
    """tan of half the conformal colatitude of a latitude in radians."""
    e = E2**0.5
    s = F.sin(lat)
    return F.tan(PI / 4 - lat / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))


def _scale(slat: float) -> float:
    import math

    e, s = E2**0.5, math.sin(abs(slat) / DEGREES)
    if abs(slat) == 90:
        return 2 * EARTH_KM / ((1 + e) ** (1 + e) * (1 - e) ** (1 - e)) ** (e / 2)
    t = math.tan(PI / 4 - abs(slat) / DEGREES / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)
    return EARTH_KM * math.cos(abs(slat) / DEGREES) / math.sqrt(1 - E2 * s * s) / t


def to_polar(lon: Column, lat: Column, slat: float = 71.0, slon: float = 0.0) -> tuple[Column, Column]:
    """(x, y) in km on the polar stereographic plane with true scale at slat."""
    radius = _scale(slat) * _conformal(F.abs(lat) / DEGREES)
    turn = (wrap_360(lon) - slon) / DEGREES
    return radius * F.sin(turn), radius * F.cos(turn)


def from_polar(x: Column, y: Column, slat: float = 71.0, slon: float = 0.0, south: bool = True) -> tuple[Column, Column]:
    """(lon, lat) in degrees; the pole itself has longitude 0. The latitude comes from the series of the conformal latitude, by powers of e squared."""
    sign = -1.0 if south else 1.0
    radius = F.hypot(x, y)
    chi = PI / 2 - 2 * F.atan(radius / _scale(slat))
    terms = (
        (E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12) * F.sin(2 * chi)
        + (7 * E2**2 / 48 + 29 * E2**3 / 240) * F.sin(4 * chi)
        + 7 * E2**3 / 120 * F.sin(6 * chi)
    )
    at_pole = radius < 0.1
    return (
        F.when(at_pole, 0.0).otherwise(F.atan2(x, y) * DEGREES + slon),
        F.when(at_pole, 90.0 * sign).otherwise(sign * (chi + terms) * DEGREES),
    )


def distance_azimuth(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    """Planar distance in km and azimuth in radians between points in degrees, with the cosine of the middle latitude."""
    east = SPHERE_KM * F.cos(F.radians((lat1 + lat2) / 2)) * F.radians(wrap_180(lon2) - wrap_180(lon1))
    north = SPHERE_KM * F.radians(lat2 - lat1)
    return F.hypot(east, north), F.atan2(east, north)


def cell_area(lat1: Column, lat2: Column, lon1: Column, lon2: Column) -> Column:
    """Area in square km of a cell of the sphere between two latitudes and two longitudes in degrees."""
    return SPHERE_KM**2 * F.abs(F.sin(F.radians(lat1)) - F.sin(F.radians(lat2))) * F.abs(F.radians(lon1) - F.radians(lon2))


def to_cartesian(lon: Column, lat: Column, radius: float = 1.0) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return radius * F.cos(b) * F.cos(a), radius * F.cos(b) * F.sin(a), radius * F.sin(b)


def box_border(left: float, right: float, bottom: float, top: float) -> Column:
    """The five corners of a closed box, as an array of (lon, lat); explode it for a border."""
    at = [(left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)]
    return F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in at])


def ice_density(freeboard: Column, thickness: Column, water: float = 1028.0) -> Column:
    """Density of floating ice from its freeboard and thickness."""
    return (1 - freeboard / thickness) * water


def planar_degrees(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.hypot(lon1 - lon2, lat1 - lat2)


def to_microradians(arc_seconds: Column, power: int = 1) -> Column:
    """Arc seconds (or their squares, power 2) in microradians."""
    return arc_seconds * MICRORADIANS**power


def to_arc_seconds(microradians: Column, power: int = 1) -> Column:
    return microradians / MICRORADIANS**power


def box_line(left: Column, right: Column, bottom: Column, top: Column, n: int = 1) -> Column:
    """The closed border of a box, each side in n steps, as an array of (lon, lat) from the lower left corner on, to the right first."""

    def at(k):
        side, u = F.floor(k / n), (k % n) / n
        across = F.when(side == 0, u).when(side == 1, 1.0).when(side == 2, 1 - u).otherwise(0.0)
        up = F.when(side == 1, u).when(side == 2, 1.0).when(side == 3, 1 - u).otherwise(0.0)
        return F.struct((left + (right - left) * across).alias("lon"), (bottom + (top - bottom) * up).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(4 * n)), at)


def subdomains(left: Column, right: Column, n: int) -> Column:
    """n equal parts of a range of longitudes as an array of (number from 1, left, right)."""
    width = (right - left) / n
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(k.alias("number"), (left + (k - 1) * width).alias("left"), (left + k * width).alias("right")))


def grid_centres(low: Column, high: Column, step: float) -> Column:
    """The cells of a range as an array of (number from 1, centre, low, high), rounded to 6 digits; the last one may end beyond the range."""
    last = F.ceil(F.round((high - low) / step, 6)).cast("int")

    def cell(k):
        at = low + (k - 1) * step
        return F.struct(k.alias("number"), F.round(at + step / 2, 6).alias("centre"), F.round(at, 6).alias("low"), F.round(at + step, 6).alias("high"))

    return F.transform(F.sequence(F.lit(1), last), cell)


def circular(array: Column, i: Column) -> Column:
    """The element at i (from 0), counted round and round."""
    return F.element_at(array, (F.pmod(i, F.size(array)) + 1).cast("int"))


def tuples(array: Column, n: int) -> Column:
    """Successive n-tuples; what is left at the end is dropped."""
    whole = F.floor(F.size(array) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), whole - 1), lambda k: F.slice(array, k * n + 1, n))


def horner(x: Column, coefficients: list[float]) -> Column:
    """A polynomial, the highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out
