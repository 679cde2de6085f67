"""All queries of the air-quality operators, with their SQL where SQL can express them."""

from . import emission_queries, fusion_queries, map_queries, proxy_queries, quality_queries, scalar_queries, scan_queries, source_queries, spatial_queries, statistics_queries, terrain_queries, time_queries  # noqa: F401
from .base import QUERIES, SQL

FLAGSHIP = "X1_flagship_aqi"


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
