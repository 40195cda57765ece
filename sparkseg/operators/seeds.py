"""Pixel density, its tie-break, unique local maxima and seed election."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseg.functions.neighbours import box, eight, with_eight


def density(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds ``psi``: the neighbour count over the weighted difference to the eight neighbours.

    The count goes by position (3 in corners, 5 at borders, else 8), also in images of one row or column.
    Adds ``flat`` where there is no difference at all.
    """
    seen = with_eight(values, F.struct("l", "a", "b"), "_n")
    for ch in "lab":
        total = F.lit(0.0)
        for n in eight("_n"):
            d = F.col(f"{n}.{ch}") - F.col(ch)
            total = total + F.coalesce(d * d, F.lit(0.0))
        seen = seen.withColumn(f"_s{ch}", total)
    joined = seen.drop("_n_left", "_n_mid", "_n_right").join(weights, "image_id")
    at_row, at_col = F.col("r").isin(1) | (F.col("r") == F.col("rows")), F.col("c").isin(1) | (F.col("c") == F.col("cols"))
    count = F.when(at_row & at_col, 3.0).when(at_row | at_col, 5.0).otherwise(8.0)
    difference = F.sqrt(F.col("alpha") * F.col("_sl") + F.col("beta") * F.col("_sa") + F.col("gamma") * F.col("_sb"))
    joined = joined.withColumn("_d", difference)
    return joined.withColumn("psi", count / (F.col("_d") + 0.1)).withColumn("flat", F.col("_d") == 0).drop("_sl", "_sa", "_sb", "_d", "alpha", "beta", "gamma")


def break_ties(dense: DataFrame, seed: int = 0) -> DataFrame:
    """Flat pixels get 80 and a small step more each, in an order drawn by hash from the seed."""
    order = F.md5(F.concat_ws(",", F.lit(str(seed)), F.col("r"), F.col("c")))
    rank = F.row_number().over(Window.partitionBy("image_id", "flat").orderBy("_h", "c", "r"))
    hashed = dense.withColumn("_h", F.when(F.col("flat"), order))
    return hashed.withColumn("psi", F.when(F.col("flat"), 80.0 + 0.0001 * rank).otherwise(F.col("psi"))).drop("_h")


def unique_maximum(df: DataFrame, radius: int, name: str, value: str = "psi") -> DataFrame:
    """Adds whether a pixel has its box's largest value and no other such pixel is in the box."""
    if radius <= 0:
        return df.withColumn(name, F.lit(True))
    peak = box(df, value, "_most", radius).withColumn("_peak", (F.col(value) == F.col("_most")).cast("int"))
    counted = box(peak, "_peak", "_peaks", radius, F.sum)
    return counted.withColumn(name, (F.col("_peak") == 1) & (F.col("_peaks") == 1)).drop("_most", "_peak", "_peaks")


def radii(rows: int, cols: int) -> tuple[int, int]:
    return max(rows, cols) // 100 + 1, max(1, min(rows, cols) // 200)


def elect(dense: DataFrame, thresholds: DataFrame, sizes: list[tuple[int, int]], fixed: tuple[int, int] | None = None) -> DataFrame:
    """Adds ``is_seed``: the large radius, or the small one where the edge reaches the threshold.

    Radii follow from the image's size, unless they are ``fixed``; images of one size go through together.
    Borders hold no seed.
    """
    joined = dense.join(thresholds, "image_id")
    parts = []
    for big, small in [fixed] if fixed else sorted({radii(*s) for s in sizes}):
        of_size = F.lit(True) if fixed else (F.floor(F.greatest("rows", "cols") / 100) + 1 == big) & (F.greatest(F.lit(1), F.floor(F.least("rows", "cols") / 200)) == small)
        part = unique_maximum(joined.where(of_size), big, "_big")
        part = unique_maximum(part, small, "_small") if small != big else part.withColumn("_small", F.col("_big"))
        parts.append(part.withColumn("radius", F.lit(big)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    inner = ~(F.col("r").isin(1) | (F.col("r") == F.col("rows")) | F.col("c").isin(1) | (F.col("c") == F.col("cols")))
    return out.withColumn("is_seed", F.when(F.col("edge") >= F.col("threshold"), F.col("_small")).otherwise(F.col("_big")) & inner).drop("_big", "_small")


def numbered(elected: DataFrame) -> DataFrame:
    """The seed table: ``image_id, seed_id`` from 1 column by column, place and channels."""
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("c", "r"))
    return elected.where("is_seed").select("image_id", number.alias("seed_id"), "r", "c", "rows", "cols", "radius", "l", "a", "b")
