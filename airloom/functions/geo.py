"""Geometry and wind as column expressions; angles in degrees, winds are directions they blow from."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree of latitude on a sphere of 6371 km.
DEGREE_M = 6371000.0 * 2 * math.pi / 360


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in degrees of latitude; the second point's latitude scales longitudes."""
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(F.cos(F.radians(lat2)) * (lon1 - lon2), 2))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """``distance`` in metres."""
    return distance(lat1, lon1, lat2, lon2) * DEGREE_M


def cell_of(lat: Column, lon: Column, latmax, lonmin, dlat, dlon):
    """(h, w) of a grid whose row 0 is north; by floor, so a point outside never lands on the edge."""
    return F.floor((F.lit(latmax) - lat) / dlat), F.floor((lon - F.lit(lonmin)) / dlon)


def clamped(index: Column, n: int) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), index))


def to_metres(lat: Column, lon: Column, lat0: Column, lon0: Column):
    """(north, east) metres from a corner."""
    return (lat - lat0) * DEGREE_M, (lon - lon0) * F.cos(F.radians(lat0)) * DEGREE_M


def box_area_km2(latmin, latmax, lonmin, lonmax) -> Column:
    mid = (latmin + latmax) / 2
    return (latmax - latmin) * DEGREE_M / 1000 * (lonmax - lonmin) * F.cos(F.radians(mid)) * DEGREE_M / 1000


def rotated(h: Column, w: Column, degrees: Column):
    a = F.radians(degrees)
    return h * F.cos(a) - w * F.sin(a), w * F.cos(a) + h * F.sin(a)


def bearing(dh: Column, dw: Column) -> Column:
    """Heading from 0 (north) clockwise of an offset north and east."""
    return F.pmod(F.degrees(F.atan2(dw, dh)) + 360.0, F.lit(360.0))


def sector(dh: Column, dw: Column, width: int) -> Column:
    return F.floor(bearing(dh, dw) / width)


def heading_to_cartesian(heading: Column) -> Column:
    return F.pmod(F.lit(450.0) - heading, F.lit(360.0))


def wind_components(direction: Column, speed: Column):
    """(north, east) parts of where the wind blows to; parts below 0.001 are zero."""
    tidy = lambda x: F.when(F.abs(x) < 0.001, 0.0).otherwise(x)
    return -tidy(speed * F.cos(F.radians(direction))), -tidy(speed * F.sin(F.radians(direction)))


def wind_direction(north: Column, east: Column) -> Column:
    """A calm keeps the side that the sign of its northern zero tells, as by IEEE arithmetic; Spark's atan2 drops that sign."""
    southerly = (north == 0) & (east == 0) & (F.pow(north, F.lit(-1.0)) > 0)
    return F.when(southerly, 180.0).otherwise(F.pmod(F.degrees(F.atan2(-east, -north)) + 360.0, F.lit(360.0)))


def wind_speed(north: Column, east: Column) -> Column:
    """Never below 0.1."""
    return F.greatest(F.lit(0.1), F.sqrt(north * north + east * east))


def apparent_wind(speed: Column, direction: Column, own_speed: Column, own_heading: Column):
    """(speed, heading) of the sum of wind and motion vectors; the wind itself for a source slower than 0.1."""
    a, b = F.radians(heading_to_cartesian(direction)), F.radians(heading_to_cartesian(own_heading))
    x, y = speed * F.cos(a) + own_speed * F.cos(b), speed * F.sin(a) + own_speed * F.sin(b)
    still = own_speed < 0.1
    return F.when(still, speed).otherwise(F.sqrt(x * x + y * y)), F.when(still, direction).otherwise(F.pmod(F.lit(450.0) - F.degrees(F.atan2(y, x)), F.lit(360.0)))


def quadratic(x: Column, low, mid, high, x_max) -> Column:
    """The parabola through (0, low), (x_max / 2, mid) and (x_max, high)."""
    b = 4 * mid - (high - low) - 4 * low
    return ((high - low) - b) * F.pow(x / x_max, 2) + b * (x / x_max) + low


def curve(x: Column, x0, x1, y0, y1, power) -> Column:
    """From y0 to y1 as x goes from x0 to x1, by a power of the relative position; flat outside."""
    rel = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x0) / (x1 - x0)))
    return y0 + (y1 - y0) * F.pow(rel, F.lit(power))


def byte_code(value: Column, low: Column, span: Column) -> Column:
    """Eight-bit affine code; NaN is -127. A constant field (span 0) codes to -125."""
    return F.when(F.isnan(value), F.lit(-127)).when(span == 0, F.lit(-125)).otherwise(F.floor((value - low) * 250 / span - 125)).cast("byte")


def byte_value(code: Column, low: Column, span: Column) -> Column:
    return F.when(code == -127, F.lit(float("nan"))).otherwise((code + 125) * span / 250 + low)


def erfc(x: Column) -> Column:
    """Complementary error function by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    z = F.abs(x)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-z * z)
    return F.when(x < 0, 2 - tail).otherwise(tail)
