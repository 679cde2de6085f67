"""Colours as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def channels(rgb: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue, 0 to 255, of a packed number."""
    return F.floor(rgb / 65536) % 256, F.floor(rgb / 256) % 256, rgb % 256


def hsb(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and brightness, both 0 to 1; greys have hue 0."""
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    span = top - low
    sector = F.when(red == top, (green - blue) / span).when(green == top, 2 + (blue - red) / span).otherwise(4 + (red - green) / span)
    return F.when(span == 0, 0.0).otherwise(F.pmod(sector * 60, F.lit(360.0))), F.when(top == 0, 0.0).otherwise(span / top), top / 255.0
