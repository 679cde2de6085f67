"""Position and power of the sun as column expressions, by the PSA algorithm (Blanco-Muriel et al., 2001)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the earth over its distance to the sun.
PARALLAX = 6371.01 / 149597890.0


def sky(sec: Column):
    """(star, ascension, declination) of the sun at seconds since 1970 UTC, the same everywhere: sidereal time of Greenwich in degrees, the others in radians."""
    days = sec / 86400.0 - 10957.5
    hours = F.pmod(sec, F.lit(86400)) / 3600.0
    node = 2.1429 - 0.0010394594 * days
    length = 4.8950630 + 0.017202791698 * days
    anomaly = 6.2400600 + 0.0172019699 * days
    ecliptic = length + 0.03341607 * F.sin(anomaly) + 0.00034894 * F.sin(2 * anomaly) - 0.0001134 - 0.0000203 * F.sin(node)
    tilt = 0.4090928 - 6.2140e-9 * days + 0.0000396 * F.cos(node)
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    return (6.6974243242 + 0.0657098283 * days + hours) * 15, ascension, F.asin(F.sin(tilt) * F.sin(ecliptic))


def seen(star: Column, ascension: Column, declination: Column, lat: Column, lon: Column):
    """(elevation, azimuth) in degrees of the sun of ``sky`` from a place; azimuth from north clockwise."""
    angle, phi = F.radians(star + lon) - ascension, F.radians(lat)
    zenith = F.acos(F.cos(phi) * F.cos(angle) * F.cos(declination) + F.sin(declination) * F.sin(phi))
    azimuth = F.degrees(F.atan2(-F.sin(angle), F.tan(declination) * F.cos(phi) - F.sin(phi) * F.cos(angle)))
    return 90 - F.degrees(zenith + PARALLAX * F.sin(zenith)), F.pmod(azimuth + 360.0, F.lit(360.0))


def position(sec: Column, lat: Column, lon: Column):
    """(elevation, azimuth) in degrees at seconds since 1970 UTC; azimuth from north clockwise."""
    return seen(*sky(sec), lat, lon)


def power(elevation: Column, most: float = 1000.0) -> Column:
    """``most`` times the sine of the elevation; 0 in twilight, -1 in the night."""
    return F.when(elevation > 0, most * F.sin(F.radians(elevation))).when(elevation > -6, 0.0).otherwise(-1.0)
