"""Secondary variables by recipes that may use each other, for stations, grids and source components.

Recipes are put in order by what they need, level by level, and evaluated over one wide table in one pass: each level is a projection, so a
variable's inputs are joined once, however many recipes use it. A missing input makes what depends on it missing, nothing else.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airloom.functions import text


def parsed(lines) -> dict:
    """Recipes from lines ``NAME = AFFINE<..>,..``; empty lines and such that start with # are left out."""
    pairs = [line.partition("=") for line in lines if line.strip() and not line.startswith("#")]
    return {name.strip(): text.affine(body) for name, _, body in pairs}


def levels(recipes: dict) -> list:
    """Names by level: a recipe's inputs are measured or of levels before its own. A circle is an error."""
    out, left = [], dict(recipes)
    while left:
        ready = [n for n, r in left.items() if not any(v in left for v in r.variables)]
        if not ready:
            raise ValueError(f"recipes need each other: {sorted(left)}")
        out.append(ready)
        left = {n: r for n, r in left.items() if n not in ready}
    return out


def measured(recipes: dict) -> list:
    """The inputs that no recipe makes."""
    return sorted({v for r in recipes.values() for v in r.variables} - set(recipes))


def value_of(recipe, of) -> Column:
    """The recipe's value; null if any input is."""
    whole = F.lit(True)
    for v in recipe.variables:
        whole = whole & of(v).isNotNull()
    return F.when(whole, recipe(of))


def evaluated(wide: DataFrame, recipes: dict, known=lambda name: None) -> DataFrame:
    """``wide`` with a column for each recipe; ``known(name)`` may give a condition under which a column's own values stand, also missing ones."""
    for names in levels(recipes):
        made = {}
        for n in names:
            value, stands = value_of(recipes[n], F.col), known(n)
            made[n] = value if n not in wide.columns or stands is None else F.when(stands, F.col(n)).otherwise(value)
        wide = wide.withColumns(made)
    return wide


def station_proxies(rows: DataFrame, recipes: dict) -> DataFrame:
    """``(source_id, sys_hour, var, value)`` of the recipes' variables from ``rows(source_id, sys_hour, var, value)``. A source that measures a variable keeps its own values and gaps."""
    names = sorted({*measured(recipes), *recipes})
    wide = rows.groupBy("source_id", "sys_hour").pivot("var", names).agg(F.first("value"))
    own = rows.filter(F.col("var").isin(*recipes)).groupBy("source_id").agg(F.collect_set("var").alias("_own"))  # names of recipes only
    wide = wide.join(own, "source_id", "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<string>")))
    found = evaluated(wide, recipes, lambda n: F.array_contains("_own", n))
    return found.unpivot(["source_id", "sys_hour"], list(recipes), "var", "value").filter("value is not null")


def grid_proxies(grids: dict, recipes: dict, by=("h", "w")) -> DataFrame:
    """``(*by, *recipes)`` for each cell of the first grid; ``grids`` names ``(columns by, value)`` frames, the others joined where they have the cell."""
    wide = None
    for name, cells in grids.items():
        own = cells.select(*by, F.col("value").alias(name))
        wide = own if wide is None else wide.join(own, list(by), "left")
    return evaluated(wide, recipes).select(*by, *recipes)


def component_proxies(wide: DataFrame, recipes: dict, n: int) -> DataFrame:
    """``wide`` with an array of ``n`` components for each recipe; each component is made from the inputs' components of the same source."""
    for names in levels(recipes):
        part = lambda recipe: F.array(*[value_of(recipe, lambda v: F.get(F.col(v), i)) for i in range(n)])  # noqa: B023, E731
        wide = wide.withColumns({name: part(recipes[name]) for name in names})
    return wide
