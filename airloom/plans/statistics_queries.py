"""Queries on fitted factors after the fit, lines of observation statistics, and road dust by hour."""

from pyspark.sql import functions as F

from airloom.functions import physics
from airloom.operators import fusion as f
from airloom.operators import temporal as t
from airloom.sources import sinks
from airloom.sources.adapters import EMISSIONS, OBS, emissions, observations
from airloom.sources.store import written

from .base import TIE, query
from .fusion_queries import ADJUST, COMPONENTS, EXPECTED, N_CAT, SERIES_OF, adjustments, expected, fold_sql, inputs, smoothed_and_filled
from .quality_queries import HOURLY
from .source_queries import folder
from .time_queries import FORECAST

c, lit = F.col, F.lit
r = lambda x, n=4: F.round(x + TIE, n)


def fitted_factors(spark, sf):
    """The written table ``(var, cat, sys_hour, factor, filled)`` of the fit's factors."""
    fit = written(f.fitted(inputs(spark, sf), N_CAT))
    return fit.select("var", "sys_hour", F.posexplode("factors").alias("cat", "factor"), lit(False).alias("filled")).withColumn("cat", c("cat").cast("long"))


@query("K6_fitted_overrides")
def k6_fitted(spark, sf):
    """The fit's factors, a row an hour."""
    p = fitted_factors(spark, sf).groupBy("var", "sys_hour").pivot("cat", list(range(N_CAT))).agg(F.first("factor"))
    return p.select("var", "sys_hour", *[r(c(str(k))).alias(f"c{k}") for k in range(N_CAT)])


@query("K13_fitted_weekly")
def k13_fitted(spark, sf):
    """Means of the fit's factors by week and category."""
    return fitted_factors(spark, sf).groupBy("var", "cat", F.floor(c("sys_hour") / 168).alias("week")).agg(r(F.avg("factor")).alias("mean"), F.count(lit(1)).alias("n"))


@query("X38_fitted_learning")
def x38_fitted(spark, sf):
    """What long-term factors learn from the fit, hour by hour."""
    return f.learned(fitted_factors(spark, sf)).select("var", "cat", "last_hour", r(c("master"), 6).alias("master"), F.posexplode("cells").alias("slot", "cell")).withColumn("cell", r(c("cell"), 6))


@query("X39_fitted_fill")
def x39_fitted(spark, sf):
    """The fit's factors smoothed, and filled for a day ahead."""
    return smoothed_and_filled(fitted_factors(spark, sf).drop("filled"))


SLOT = "CASE (sys_hour // 24 + 3) % 7 WHEN 5 THEN 24 WHEN 6 THEN 48 ELSE 0 END + sys_hour % 24"
FACTORS = ", ".join(f"max(CASE WHEN cat = {k} THEN factor END) AS c{k}" for k in range(N_CAT))
MEMORY = ", ".join(f"max(CASE WHEN cat = {k} THEN cells END) AS m{k}" for k in range(N_CAT))


@query("K4_observation_lines", f"""WITH RECURSIVE {COMPONENTS}{ADJUST.removeprefix(HOURLY)}, {fold_sql()}, done AS (SELECT var, cat, arg_max(cells, k) AS cells FROM fold GROUP BY ALL), memory AS (SELECT var, {MEMORY} FROM done GROUP BY var), factors AS (SELECT var, sys_hour, {FACTORS} FROM adj GROUP BY ALL)
SELECT var, source_id, sys_hour, 1 + maturity AS imprecision, round(value + {TIE}, 2) AS value, round({EXPECTED} + {TIE}, 2) AS prediction, {', '.join(f'round(p{k} + {TIE}, 2) AS p{k}' for k in range(N_CAT))}, {', '.join(f'round(c{k} + {TIE}, 1) AS c{k}' for k in range(N_CAT))}, {', '.join(f'round(m{k}[{SLOT} + 1] + {TIE}, 4) AS m{k}' for k in range(N_CAT))}
FROM comp JOIN factors USING (var, sys_hour) JOIN memory USING (var)""")
def k4_lines(spark, sf):
    """A line for each observation: what was measured and predicted, the prediction's parts, the hour's factors and those remembered for its day type and hour."""
    a = written(adjustments(spark, sf))
    factors = a.groupBy("var", "sys_hour").pivot("cat", list(range(N_CAT))).agg(F.first("factor"))
    memory = f.learned(a).groupBy("var").pivot("cat", list(range(N_CAT))).agg(F.first("cells"))
    memory = memory.select("var", *[c(str(k)).alias(f"m{k}") for k in range(N_CAT)])
    kind = (F.floor(c("sys_hour") / 24) + 3) % 7
    slot = (F.when(kind == 5, 24).when(kind == 6, 48).otherwise(0) + c("sys_hour") % 24).cast("int")
    rows = expected(spark, sf).join(factors, ["var", "sys_hour"]).join(F.broadcast(memory), "var")  # a row a variable
    return rows.select(
        "var", "source_id", "sys_hour", (1 + c("maturity")).alias("imprecision"), r(c("value"), 2).alias("value"), r(c("expected"), 2).alias("prediction"),
        *[r(c("parts")[k], 2).alias(f"p{k}") for k in range(N_CAT)], *[r(c(str(k)), 1).alias(f"c{k}") for k in range(N_CAT)], *[r(F.get(c(f"m{k}"), slot)).alias(f"m{k}") for k in range(N_CAT)],
    )


AHEAD = f"WITH {SERIES_OF}, {FORECAST} SELECT var, source_id AS cat, sys_hour, value FROM forecast"


@query("K5_forecast_lines", f"""WITH {COMPONENTS}{ADJUST.removeprefix(HOURLY)}, ahead AS ({AHEAD}), factors AS (SELECT var, sys_hour, {FACTORS.replace('factor', 'value')} FROM ahead GROUP BY ALL), last AS (SELECT var, max(sys_hour) AS last FROM adj GROUP BY var),
own AS (SELECT * FROM comp QUALIFY row_number() OVER (PARTITION BY var, source_id ORDER BY sys_hour DESC) = 1)
SELECT var, source_id, f.sys_hour, f.sys_hour - last AS lead, round(c0 + {TIE}, 4) AS c0, round(c1 + {TIE}, 4) AS c1, round(c2 + {TIE}, 4) AS c2, round(c3 + {TIE}, 4) AS c3, round(greatest(0, p0 + c0 + p1 * c1 + p2 * c2 + p3 * c3) + {TIE}, 3) AS prediction FROM own JOIN factors f USING (var) JOIN last USING (var)""")
def k5_lines(spark, sf):
    """A line for each station and filled hour to come: the factors of that hour, and the prediction with the parts of the station's last hour; written and read back as delimited text."""
    a = adjustments(spark, sf).withColumnRenamed("factor", "value")
    ahead = written(t.forecast_filled(a, 24, ["var", "cat"]))
    factors = ahead.groupBy("var", "sys_hour").pivot("cat", list(range(N_CAT))).agg(F.first("value"))
    start = ahead.groupBy("var").agg((F.min("sys_hour") - 1).alias("last"))
    own = expected(spark, sf).groupBy("var", "source_id").agg(F.max_by("parts", "sys_hour").alias("p"))
    rows = own.join(factors, "var").join(F.broadcast(start), "var")  # a row a variable
    total = c("p")[0] + c("0") + sum(c("p")[k] * c(str(k)) for k in range(1, N_CAT))
    lines = rows.select("var", "source_id", "sys_hour", (c("sys_hour") - c("last")).alias("lead"), *[r(c(str(k))).alias(f"c{k}") for k in range(N_CAT)], r(F.greatest(lit(0.0), total), 3).alias("prediction"))
    path = folder(spark, "forecast")
    sinks.statistics(lines, path)
    return spark.read.schema(lines.schema).option("sep", ";").option("header", "true").csv(path)


WEAR = " ".join(f"WHEN {k} THEN {v}" for k, v in physics.WEAR.items())
SWING = "(1 + 0.6 * cos((({h}) - 8) * pi() / 12)) / 24"


@query("X44_road_dust_by_hour", f"""WITH {EMISSIONS}, {OBS}, rain AS (SELECT sys_hour % 24 AS hour, avg(value) / 100 AS rain FROM obs WHERE var = 'click' GROUP BY ALL), road AS (SELECT emitter, cat, min(h) AS h, min(w) AS w, max(month(day)) AS month, sum(rate) AS flow FROM emissions WHERE cat <= 4 GROUP BY ALL),
piece AS (SELECT emitter, min(h) AS h, min(w) AS w, max(month) AS month, {', '.join(f'coalesce(sum(flow) FILTER (cat = {k}), 0) AS f{k}' for k in physics.WEAR)} FROM road GROUP BY emitter),
hours AS (SELECT *, unnest(range(0, 24)) AS hour FROM piece), worn AS (SELECT *, {' + '.join(f'f{k} * {v}' for k, v in physics.WEAR.items())} AS worn, ({SWING.format(h='hour')} + {SWING.format(h='hour - 2')}) / 2 AS share FROM hours)
SELECT emitter, worn.hour, round(power(worn * share * CASE WHEN month IN (11, 12, 1, 2, 3) THEN 1.5 ELSE 1 END, 0.6) * CASE WHEN w % 10 = 0 THEN 2.5 ELSE 1 END / (3.5 * (1 + h % 4)) * (1 - 0.9 * power(greatest(0, least(1, coalesce(rain, 0) / 2)), 0.5)) + {TIE}, 5) AS dust FROM worn LEFT JOIN rain ON rain.hour = worn.hour""")
def x44_hours(spark, sf):
    """Dust of a road per metre of its width: wear by the vehicle classes' flows of this hour and two hours before, surface, season and the wetness of the hour."""
    o = observations(spark, sf).filter("var = 'click'").groupBy((c("sys_hour") % 24).alias("hour")).agg((F.avg("value") / 100).alias("rain"))
    road = emissions(spark, sf).filter("cat <= 4").groupBy("emitter").pivot("cat", list(physics.WEAR)).agg(F.sum("rate"), F.min("h").alias("h"), F.min("w").alias("w"), F.max(F.month("day")).alias("m"))
    of = lambda k, what: c(f"{k}_{what}")
    road = road.select("emitter", F.array(*[F.coalesce(of(k, "sum(rate)"), lit(0.0)) for k in physics.WEAR]).alias("flows"), F.least(*[of(k, "h") for k in physics.WEAR]).alias("h"), F.least(*[of(k, "w") for k in physics.WEAR]).alias("w"), F.greatest(*[of(k, "m") for k in physics.WEAR]).alias("m"))
    hours = road.select("*", F.explode(F.sequence(lit(0).cast("long"), lit(23).cast("long"))).alias("hour")).join(F.broadcast(o), "hour", "left")  # 24 rows
    swing = lambda h: (1 + 0.6 * F.cos((h - 8) * lit(3.141592653589793) / 12)) / 24
    flows = lambda h: F.transform("flows", lambda x: x * swing(h))
    dust = physics.road_dust(flows(c("hour")), flows(c("hour") - 2), c("m").isin(11, 12, 1, 2, 3), c("w") % 10 == 0, 3.5 * (1 + c("h") % 4), F.coalesce("rain", lit(0.0)))
    return hours.select("emitter", "hour", r(dust, 5).alias("dust"))
