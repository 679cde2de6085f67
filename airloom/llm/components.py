"""Connected components of a graph given as links between 64-bit vertices."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def flattened(up: DataFrame) -> DataFrame:
    """``(v, root)`` with each vertex's root followed to its end; paths halve in each step."""
    while True:
        above = up.select(F.col("v").alias("root"), F.col("root").alias("above"))
        up = written(up.join(above, "root").select("v", F.col("above").alias("root"), (F.col("root") != F.col("above")).alias("moved")))
        moved = not up.filter("moved").isEmpty()
        up = up.select("v", "root")
        if not moved:
            return up


def components(links: DataFrame) -> DataFrame:
    """``(v, root)`` for each vertex of ``links(a, b)``; vertices have the same root if and only if they are connected.

    Each round points every vertex to its smallest neighbour, follows the pointers to their ends and
    contracts the links to those ends; links within a contracted part vanish, so each round reads far fewer. All state is in
    written tables; only a yes or no comes to the driver.
    """
    links, labels = links.select("a", "b"), None
    while True:
        both = links.union(links.select("b", "a"))
        up = flattened(written(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("root"))))
        if labels is None:
            labels = up
        else:
            more = up.select(F.col("v").alias("root"), F.col("root").alias("above"))
            labels = written(labels.join(more, "root", "left").select("v", F.coalesce("above", "root").alias("root")))
        a, b = up.select(F.col("v").alias("a"), F.col("root").alias("ra")), up.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        links = written(links.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if links.isEmpty():
            return labels
