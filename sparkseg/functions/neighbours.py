"""Windows over the two axes of a raster ``(image_id, r, c)``.

A two-dimensional box is two passes of one axis each, so a pixel never meets more than 2r+1 others
at a time and no join is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def down() -> WindowSpec:
    """Along a column of an image."""
    return Window.partitionBy("image_id", "c").orderBy("r")


def across() -> WindowSpec:
    """Along a row of an image."""
    return Window.partitionBy("image_id", "r").orderBy("c")


def box(df: DataFrame, source: str, name: str, radius: int, combine: Callable = F.max) -> DataFrame:
    """``combine`` over the (2 radius + 1)-square around each pixel, cut at the border."""
    first = combine(source).over(down().rangeBetween(-radius, radius))
    return df.withColumn("_pass", first).withColumn(name, combine("_pass").over(across().rangeBetween(-radius, radius))).drop("_pass")


def four(value: Column) -> list[Column]:
    """The values above, below, left and right; null outside."""
    return [F.lag(value).over(down()), F.lead(value).over(down()), F.lag(value).over(across()), F.lead(value).over(across())]


def with_eight(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds three columns of three values, ``{name}_left``, ``{name}_mid``, ``{name}_right``: up, same, down.

    ``{name}_mid.same`` is the pixel itself; neighbours outside the image are null.
    """
    column = F.struct(F.lag(value).over(down()).alias("up"), value.alias("same"), F.lead(value).over(down()).alias("down"))
    df = df.withColumn(f"{name}_mid", column)
    return df.withColumn(f"{name}_left", F.lag(f"{name}_mid").over(across())).withColumn(f"{name}_right", F.lead(f"{name}_mid").over(across()))


def eight(name: str) -> list[str]:
    """The names of the eight neighbours that ``with_eight`` added."""
    return [f"{name}_{side}.{at}" for side in ("left", "mid", "right") for at in ("up", "same", "down") if (side, at) != ("mid", "same")]


def extent(df: DataFrame) -> DataFrame:
    """``image_id, rows, cols``."""
    return df.groupBy("image_id").agg(F.max("r").alias("rows"), F.max("c").alias("cols"))
