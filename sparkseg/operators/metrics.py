"""Boundaries, their recall, and overlap of a label map with annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseg.functions.neighbours import box, extent, four


def boundary(label: str) -> Column:
    """Whether a four-neighbour has another label."""
    return _any([F.coalesce(n != F.col(label), F.lit(False)) for n in four(F.col(label))])


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def tolerance(rows: int, cols: int) -> int:
    return int(0.0025 * (rows * rows + cols * cols) ** 0.5 + 0.5)


def masks(pairs: DataFrame, sizes: list[tuple[int, int]], fixed: int | None = None) -> DataFrame:
    """Adds ``gt_edge``, ``sp_edge`` and ``matched`` to ``pairs(image_id, r, c, label, region)``.

    ``matched`` is the label boundary widened by the tolerance, which follows from the image's size unless it is ``fixed``.
    """
    marked = pairs.withColumn("gt_edge", boundary("region")).withColumn("sp_edge", boundary("label")).join(extent(pairs), "image_id")
    radius = F.lit(fixed) if fixed is not None else F.floor(0.0025 * F.sqrt((F.col("rows") * F.col("rows") + F.col("cols") * F.col("cols")).cast("double")) + 0.5)
    parts = []
    for t in [fixed] if fixed is not None else sorted({tolerance(*s) for s in sizes}):
        part = marked.where(radius == t).withColumn("_on", F.col("sp_edge").cast("int"))
        parts.append(box(part, "_on", "_near", t).withColumn("matched", F.col("_near") == 1).drop("_on", "_near") if t else part.withColumn("matched", F.col("sp_edge")).drop("_on"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("rows", "cols")


def _recall(where: Column) -> Column:
    hit, all_ = F.count_if(where & F.col("matched")), F.count_if(where)
    return F.when(all_ > 0, hit / all_)


def boundary_recall(masked: DataFrame) -> DataFrame:
    """``image_id, br``; NaN without any annotated boundary."""
    return masked.groupBy("image_id").agg(F.coalesce(_recall(F.col("gt_edge")), F.lit(float("nan"))).alias("br"))


def instance_recall(masked: DataFrame) -> DataFrame:
    """``image_id, ibr``: the mean of the recalls of regions that have a boundary; NaN if none has."""
    each = masked.groupBy("image_id", "region").agg(_recall(F.col("gt_edge")).alias("_br"))
    return each.groupBy("image_id").agg(F.coalesce(F.avg("_br"), F.lit(float("nan"))).alias("ibr"))


def table(rows: DataFrame) -> DataFrame:
    """``image_id, ground_truth, br, ibr`` and a row ``mean`` per image, in which NaN propagates."""
    means = rows.groupBy("image_id").agg(F.avg("br").alias("br"), F.avg("ibr").alias("ibr")).select("image_id", F.lit("mean").alias("ground_truth"), "br", "ibr")
    return rows.select("image_id", "ground_truth", "br", "ibr").unionByName(means)


def contingency(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("image_id", "label", "region").agg(F.count("*").alias("n"))


def achievable_accuracy(pairs: DataFrame) -> DataFrame:
    """``image_id, asa``: the share of pixels in the region that their label overlaps most."""
    largest = contingency(pairs).groupBy("image_id", "label").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return largest.groupBy("image_id").agg((F.sum("most") / F.sum("all")).alias("asa"))


def recall_classes(masked: DataFrame) -> DataFrame:
    """Adds ``class``: recalled, missed, superpixel (only), or none."""
    return masked.withColumn("class", F.when(F.col("gt_edge") & F.col("matched"), "recalled").when(F.col("gt_edge"), "missed").when(F.col("sp_edge"), "superpixel").otherwise("none"))


def display_bytes(pixels: DataFrame, bits: str = "byte") -> DataFrame:
    """Channels as bytes for display: floats up to 1 are stretched by 255, other floats clipped and rounded."""
    if bits == "byte":
        return pixels.withColumns({ch: F.col(ch).cast("int") for ch in ("red", "green", "blue")})
    most = pixels.groupBy("image_id").agg(F.max(F.greatest("red", "green", "blue")).alias("_most"))
    clip = lambda x, top: F.least(F.greatest(x, F.lit(0.0)), F.lit(top))
    shown = pixels.join(most, "image_id")
    return shown.withColumns({ch: F.when(F.col("_most") <= 1, F.round(255 * clip(F.col(ch), 1.0))).otherwise(clip(F.round(ch), 255.0)).cast("int") for ch in ("red", "green", "blue")}).drop("_most")


def overlay(pixels: DataFrame, label: str = "label", color: tuple[int, int, int] = (255, 0, 0)) -> DataFrame:
    """Pixels with the label boundary painted."""
    on = pixels.withColumn("_on", boundary(label))
    return on.withColumns({ch: F.when(F.col("_on"), F.lit(v)).otherwise(F.col(ch)) for ch, v in zip(("red", "green", "blue"), color)}).drop("_on")


def show_recall(classed: DataFrame) -> DataFrame:
    """Pixels painted by class: superpixel-only green, recalled black, missed red."""
    paint = {"superpixel": (0, 255, 0), "recalled": (0, 0, 0), "missed": (255, 0, 0)}
    out = {}
    for i, ch in enumerate(("red", "green", "blue")):
        value = F.col(ch)
        for name, rgb in paint.items():
            value = F.when(F.col("class") == name, F.lit(rgb[i])).otherwise(value)
        out[ch] = value
    return classed.withColumns(out)
