"""Tags, maps, ids and dates in text, as column expressions; affine expressions from text."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted date patterns, first match wins.
DATE_PATTERNS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy HH:mm", "dd.MM.yyyy", "yyyyMMddHH", "yyyyMMdd"]
TERM = re.compile(r"\s*([+-]?\s*[0-9.]+(?:[eE][+-]?[0-9]+)?)\s*\*\s*(\w+)\s*")
TAG = re.compile(r"([A-Za-z0-9_]+)<([^<>]*)>")


def tag(text: Column, name: str) -> Column:
    """The value of ``NAME<value>``; null if absent."""
    return F.nullif(F.regexp_extract(text, rf"(?:^|[^A-Za-z0-9_]){name}<([^<>]*)>", 1), F.lit(""))


def pairs(text: Column) -> Column:
    """``a=1,b=2`` as a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def short_id(text: Column) -> Column:
    return F.upper(F.concat_ws("_", F.slice(F.split(text, "_"), 1, 3)))


def clean_id(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "[^A-Za-z0-9]+", "_")


def coordinate_id(lat: Column, lon: Column) -> Column:
    return F.concat_ws("_", F.lit("ID"), F.format_number(lat, 4), F.format_number(lon, 4))


def parsed_time(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS])


def affine(text: str):
    """A function of a name-to-column lookup from ``AFFINE<a*X+b*Y>`` with ``X_MIN<..>`` and ``X_MAX<..>`` limits; None for other expressions."""
    tags = dict(TAG.findall(text))
    if "AFFINE" not in tags:
        return None
    body, terms, at = re.sub(r"\+\s*-", "-", tags["AFFINE"]), [], 0
    while at < len(body):
        m = TERM.match(body, at)
        if not m:
            raise ValueError(f"not a sum of products of a number and a variable: {body!r}")
        terms.append((float(m[1].replace(" ", "")), m[2]))
        at = m.end()

    def column(of) -> Column:
        out = None
        for a, name in terms:
            x = of(name)
            if f"{name}_MIN" in tags:
                x = F.greatest(x, F.lit(float(tags[f"{name}_MIN"])))
            if f"{name}_MAX" in tags:
                x = F.least(x, F.lit(float(tags[f"{name}_MAX"])))
            out = a * x if out is None else out + a * x
        return out

    column.variables = [name for _, name in terms]
    return column
