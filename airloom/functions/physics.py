"""Dispersion, meteorology, chemistry and index formulas as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import curve

#: Per variable, the nugget b and the coefficients of lag^4, lag^3, lag^2 and lag.
VARIOGRAM = {
    "SO2": (4.0, 0.0, 0.0015, -0.0934, 1.874),
    "PM25": (4.0, 0.0, 0.004, -0.2799, 7.1896),
    "CO": (1000.0, 0.3374, -16.084, 145.44, 1651.3),
    "O3": (20.0, 0.0105, -0.4687, 2.799, 85.227),
    "NO2": (20.0, 0.0046, -0.1, 145.8, 74.82),
    "PM10": (20.0, 0.0, 0.0302, -1.7555, 32.061),
    "temperature": (0.9, 0.00005, -0.00036, 0.0711, 0.3737),
    "wind": (0.9, 0.0000005, -0.00033, 0.0247, 0.5793),
    "rain": (0.9, 0.00005, -0.00036, 0.0711, 0.3737),
    "generic": (20.0, 0.0, 0.004, -0.2799, 7.1896),
}
MAX_LAG_H = 35
#: Per pollutant, cubic from index to concentration below and above the index threshold.
US_INDEX = {
    "O3": ((0.000306, -0.0608, 4.3904, 0.0), (-1e-5, 0.0089, 0.8126, 20.482)),
    "CO": ((-0.004, 0.7424, 75.0, 0.0), (-0.0006, 0.5816, -27.09, 6788.0)),
    "NO2": ((0.0006, -0.086, 4.9278, 0.0), (0.0, -0.0089, 15.004, -1300.9)),
    "PM25": ((0.0, 0.000874, 0.2405, 0.0), (1.3e-5, -0.0131, 5.0726, -455.22)),
    "PM10": ((-2.13e-5, 0.0084, 0.91333, 0.0), (1.11e-5, -0.0117, 4.5839, -200.9)),
    "SO2": ((0.0002, -0.0319, 2.8817, 0.0), (-2e-6, -0.003, 8.9406, -802.0)),
}
#: Per stability class A to D and EF, factors and slopes of sigma y and sigma z.
SIGMA = {"A": (0.32, 0.0004, 0.24, 0.001), "B": (0.28, 0.0004, 0.21, 0.0015), "C": (0.22, 0.0004, 0.18, 0.0025), "D": (0.16, 0.0004, 0.14, 0.003), "EF": (0.11, 0.0004, 0.08, 0.004)}
CLASSES = list(SIGMA)


def imprecision(scaler: Column, type_factor) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.pow(scaler, F.lit(1.4)) * type_factor))


def nugget(var: str) -> float:
    return VARIOGRAM.get(var, VARIOGRAM["generic"])[0]


def temporal_variance(var: str, lag: Column) -> Column:
    b, t4, t3, t2, t1 = VARIOGRAM.get(var, VARIOGRAM["generic"])
    x = F.least(F.abs(lag), F.lit(float(MAX_LAG_H)))
    return t4 * x * x * x * x + t3 * x * x * x + t2 * x * x + t1 * x + b


def observation_variance(var: str, maturity: Column, scaler: Column, dist_km, lag_h) -> Column:
    """Nugget times factors for forecast lead, station, distance and time lag."""
    lag = F.least(F.abs(F.lit(lag_h) if not isinstance(lag_h, Column) else lag_h), F.lit(float(MAX_LAG_H)))
    return nugget(var) * (1 + maturity / 48.0) * scaler * (1 + 10 * dist_km) * (1 + lag)


def index_of(value: Column, low: float, high: float, power: float, top: float = 5.0) -> Column:
    """Air-quality index from 1 to ``top`` by a pollutant's curve."""
    return curve(value, low, high, 1.0, top, power)


def combined_index(parts: list, how: str) -> Column:
    """Of several indices, nulls left out: the largest, the self-weighted or the plain mean."""
    a = F.filter(F.array(*parts), lambda x: x.isNotNull())
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    if how == "max":
        return F.array_max(a)
    if how == "self":
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / total
    return total / F.size(a)


def us_concentration(pollutant: str, index: Column, threshold: float = 150.0, top: float = 500.0) -> Column:
    low, high = US_INDEX[pollutant]
    x = F.greatest(F.lit(0.0), F.least(F.lit(top), index))
    cubic = lambda p: p[0] * x * x * x + p[1] * x * x + p[2] * x + p[3]
    return F.when(x > threshold, cubic(high)).otherwise(cubic(low))


def us_index(pollutant: str, value: Column, threshold: float = 150.0, top: float = 500.0, steps: int = 5000) -> Column:
    """The index at which the rising cubic reaches a concentration, on a grid of ``steps``, by bisection."""
    ends = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def half(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2)
        below = us_concentration(pollutant, mid * (top / steps), threshold, top) <= value
        return ends(F.when(below, mid).otherwise(s["lo"]), F.when(below, s["hi"]).otherwise(mid))

    start = ends(F.lit(0).cast("long"), F.lit(steps).cast("long"))
    rounds = F.sequence(F.lit(1), F.lit(steps.bit_length()))
    return F.aggregate(rounds, start, half, lambda s: s["lo"] * (top / steps))


def stability_from_length(inv_mo: Column) -> Column:
    """0 to 3 (A to D); the stable classes are taken as neutral."""
    return F.when(inv_mo < -0.056, 0).when(inv_mo < -0.016, 1).when(inv_mo < -0.004, 2).otherwise(3)


def stability_from_radiation(radiation: Column, speed: Column) -> Column:
    calm = speed <= 3
    return (
        F.when(radiation <= 0, 3)
        .when(radiation < 100, F.when(calm, 2).otherwise(3))
        .when(radiation < 250, F.when(calm, 1).otherwise(2))
        .otherwise(F.when(calm, 0).otherwise(1))
    )


def stability_at_height(stability: Column, height: Column) -> Column:
    return F.least(F.lit(4).cast("long"), (stability + F.floor(height / 30)).cast("long"))


def shortwave(solar: Column, cloud: Column) -> Column:
    return F.greatest(F.lit(0.0), solar) * F.least(F.lit(1.0), 0.2 + 2 / (cloud + 1))


def log_wind(speed: Column, roughness: Column, height: Column, plane=0.0, default_roughness=0.2, least_height=2.0) -> Column:
    """Speed at a height from the speed at 10 m."""
    h, r = F.greatest(height, F.lit(least_height)), F.greatest(F.lit(0.01), F.least(F.lit(2.0), roughness))
    return speed * F.log((h - plane) / r) / F.log((F.lit(10.0) - plane) / F.lit(default_roughness))


def sigma_y(x: Column, cls: str) -> Column:
    a, b, _, _ = SIGMA[cls]
    return a * x * F.pow(1 + b * x, F.lit(-0.5))


def sigma_z(x: Column, cls: str) -> Column:
    _, _, a, b = SIGMA[cls]
    return a * x * F.pow(1 + b * x, F.lit(-0.5))


def by_class(cls: Column, f) -> Column:
    """``f(name)`` of the class that a column numbers."""
    out = f(CLASSES[-1])
    for k in reversed(range(len(CLASSES) - 1)):
        out = F.when(cls == k, f(CLASSES[k])).otherwise(out)
    return out


def reflection(rz: Column, z: Column, height: Column) -> Column:
    """Vertical term of a plume and its mirror image at the ground; rz is half of sigma z squared."""
    return F.exp(-F.pow(z - height, 2) / 4 / rz) + F.exp(-F.pow(z + height, 2) / 4 / rz)


def lid_series(rz: Column, z: Column, height: Column, depth: Column, n: int) -> Column:
    """Vertical term under an inversion lid, by ``n`` cosine terms; zero above the lid."""
    total = F.lit(0.5)
    for k in range(1, n + 1):
        a = k * F.lit(3.141592653589793) / depth
        total = total + F.cos(a * z) * F.cos(a * height) * F.exp(-rz * a * a)
    return F.when((z > depth) | (height > depth), 0.0).otherwise(total / depth)


def plume(x: Column, y: Column, z: Column, height: Column, speed: Column, depth: Column, cls: Column) -> Column:
    """Concentration per unit emission downwind: free plume below two mixing depths, lid series beyond three, blended between."""
    sy, sz = by_class(cls, lambda c: sigma_y(x, c)), by_class(cls, lambda c: sigma_z(x, c))
    ry, rz = sy * sy / 2, sz * sz / 2
    r = F.sqrt(ry * rz)
    pi = 3.141592653589793
    side = F.exp(-y * y / (4 * ry))
    free = side * reflection(rz, z, height) / (4 * pi * r)
    lid = side * lid_series(rz, z, height, depth, 3) / F.sqrt(pi * r)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / depth - 2))
    return F.when((z >= depth) | (height >= depth), 0.0).otherwise((share * lid + (1 - share) * free) / speed)


def settling(rz: Column, z: Column, height: Column, velocity=0.02, diffusivity=5.0) -> Column:
    return F.exp(velocity * (z - height) / (-2 * diffusivity) - velocity * velocity * rz / (4 * diffusivity * diffusivity))


def distance_ramp(limit: Column, dist: Column) -> Column:
    return F.when(limit <= 0, 1.0).otherwise(F.least(F.greatest(dist, F.lit(1.0)), limit) / limit)


def transport_wind(upper: Column, surface: Column, dist: Column) -> Column:
    share = F.greatest(F.lit(0.4), F.least(F.lit(0.8), dist / 500))
    return share * upper + (1 - share) * surface


def wind_fan(direction: Column, speed: Column) -> Column:
    """Directions to compute: six fixed ones in a calm, three or two around the wind if it is weak, else the wind."""
    turn = lambda d: F.pmod(direction + d, F.lit(360.0))
    return (
        F.when(speed <= 0.3, F.array(*[F.lit(float(d)) for d in range(0, 360, 60)]))
        .when(speed <= 0.6, F.array(direction, turn(30.0), turn(-30.0)))
        .when(speed <= 0.8, F.array(turn(-10.0), turn(10.0)))
        .otherwise(F.array(direction))
    )


def nox_split(nox: Column):
    """(NO2, NO, O3) parts of nitrogen oxides."""
    return 0.85 * nox, 0.15 * nox, -0.65 * nox


#: Fixed values of this library: road wear of the vehicle classes, its growth by studded tyres, and dust of dirt roads.
WEAR, STUDS, DIRT = {1: 1.0, 2: 1.6, 3: 2.8, 4: 0.4}, 1.5, 2.5


def road_dust(flows: Column, before: Column, winter: Column, dirt: Column, width_m: Column, rain_mm: Column) -> Column:
    """Dust of a road by its width: the 0.6th power of wear by the mean flows of two hours, more on dirt, down to a tenth when it is wet.

    ``flows`` and ``before`` are arrays by vehicle class, in the order of ``WEAR``."""
    worn = F.lit(0.0)
    for k, wear in enumerate(WEAR.values()):
        worn = worn + (flows[k] + before[k]) / 2 * wear
    dust = F.pow(worn * F.when(winter, STUDS).otherwise(1.0), F.lit(0.6)) * F.when(dirt, DIRT).otherwise(1.0)
    return dust / width_m * curve(rain_mm, 0.0, 2.0, 1.0, 0.1, 0.5)
