"""Registries for what users add: expressions, proxy recipes, emitters, feeds, background strategies; the built-in ones are in them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.functions import text
from airloom.operators import dispersion
from airloom.sources import files

EXPRESSIONS = {"AFFINE": text.affine}
#: Proxy variables: name -> expression over other variables.
RECIPES = {"PM10": text.affine("AFFINE<1.4*click+0.6*view>,click_MAX<100>")}
#: Feeds: name -> f(spark, paths, ...) -> observations with at least var, source_id, ts and value.
FEEDS = {"text": files.long_observations, "table": files.wide_observations, "xml": files.open_data}
#: Emitters by the type tag of an inventory's name: f(rows) -> (h, w, cat, pollutant, height_m, rate).
EMITTERS = {
    "GRID": lambda rows: rows.select("h", "w", "cat", "pollutant", "height_m", "rate"),
    "LINE": lambda rows: dispersion.line_cells(rows.withColumns({"h0": F.col("h"), "w0": F.col("w"), "h1": F.col("h") + 4, "w1": F.col("w")}).drop("h", "w")).select("h", "w", "cat", "pollutant", "height_m", (F.col("rate") / F.col("n")).alias("rate")),
}
#: Regional background from hourly values (var, source_id, sys_hour, value): f(rows) -> (var, sys_hour, background).
BACKGROUNDS = {
    "least": lambda rows: rows.groupBy("var", "sys_hour").agg(F.min("value").alias("background")),
    "half": lambda rows: rows.groupBy("var", "sys_hour").agg((0.5 * F.min("value")).alias("background")),
}


def register(registry: dict, name: str):
    def add(f):
        registry[name] = f
        return f

    return add


def expression(source: str):
    """The first registered expression that reads the text; None if none does."""
    return next((e for e in (f(source) for f in EXPRESSIONS.values()) if e is not None), None)


def closed_over(requested, recipes: dict):
    """The requested variables and all that their recipes need; recipes not needed are left out."""
    need, todo = set(), list(requested)
    while todo:
        v = todo.pop()
        if v not in need:
            need.add(v)
            todo += recipes[v].variables if v in recipes else []
    return need, {v: r for v, r in recipes.items() if v in need}


def fusion_order(variables):
    """Ozone first: its factors are an input of the nitrogen oxides' chemistry."""
    return sorted(variables, key=lambda v: v != "O3")


def ingested(spark, sources, feeds=None) -> DataFrame:
    """Observations of ``sources`` [(feed, arguments)] by the registered feeds (or ``feeds``), as one table with the feed's name."""
    out = None
    for name, arguments in sources:
        rows = (feeds or FEEDS)[name](spark, *arguments).select("var", "source_id", "ts", "value", F.lit(name).alias("feed"))
        out = rows if out is None else out.unionByName(rows)
    return out


def emitted(rows: DataFrame) -> DataFrame:
    """Inventory rows as emission cells, each type by its emitter; types without one are left out."""
    parts = [f(rows.filter(F.col("type") == tag)) for tag, f in EMITTERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
