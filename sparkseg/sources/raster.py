"""Pixel relations from tables and images.

``pixels(image_id, r, c, red, green, blue)``: rows and columns from 1; a batch of images is more rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseg.errors import EdgeSizeMismatch, InvalidEdgeMode, InvalidImage, MissingEdgeMap
from sparkseg.functions.ordinal import with_ordinal
from sparkseg.operators.channels import sobel

HEIGHT, WIDTH = 250, 64


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test images from the ``embeddings`` table: 250 vectors are one image of 250 x 64.

    Even images are raw, odd ones made of blocks of 5 x 4 pixels; ``region`` is an annotation.
    """
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").alias("lab"), "embedding")
    k = with_ordinal(vectors, "vec_id", "k")
    odd = F.col("k").cast("long") % (2 * HEIGHT) >= HEIGHT
    taken = F.when(odd, F.col("k") - F.col("k") % 5).otherwise(F.col("k"))
    rows = k.select("k", "lab", odd.alias("odd"), taken.alias("from"))
    source = k.select(F.col("k").alias("from"), "embedding")
    cells = rows.join(source, "from").select("k", "lab", "odd", "embedding", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("p"))

    def byte(offset: int):
        at = F.when(F.col("odd"), F.col("p") - F.col("p") % 4).otherwise(F.col("p")) + offset
        value = F.element_at("embedding", (at % WIDTH + 1).cast("int")).cast("double")
        return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((value + 0.5) * 8.0).cast("int") * 32))

    return cells.select(
        F.expr(f"k div {HEIGHT}").cast("long").alias("image_id"), (F.col("k") % HEIGHT + 1).cast("int").alias("r"), (F.col("p") + 1).cast("int").alias("c"),
        byte(0).alias("red"), byte(20).alias("green"), byte(41).alias("blue"), (F.col("lab") * 4 + F.expr("p div 16")).cast("int").alias("region"),
    )


def from_gray(values: DataFrame, name: str = "gray") -> DataFrame:
    """One channel as three."""
    return values.select("image_id", "r", "c", *(F.col(name).alias(ch) for ch in ("red", "green", "blue")))


def from_arrays(spark: SparkSession, images: dict[int, object]) -> DataFrame:
    """Arrays of rows x columns (gray) or rows x columns x 3."""
    import numpy as np
    import pandas as pd

    parts = []
    for image_id, array in images.items():
        a = np.asarray(array)
        if a.ndim == 2:
            a = np.repeat(a[:, :, None], 3, axis=2)
        if a.ndim != 3 or a.shape[2] != 3:
            raise InvalidImage("input must be an RGB or grayscale image")
        r, c = np.meshgrid(np.arange(1, a.shape[0] + 1), np.arange(1, a.shape[1] + 1), indexing="ij")
        parts.append(pd.DataFrame({"image_id": image_id, "r": r.ravel(), "c": c.ravel(), **{ch: a[:, :, k].ravel() for k, ch in enumerate(("red", "green", "blue"))}}))
    kind = "double" if any(np.asarray(x).dtype.kind == "f" for x in images.values()) else "int"
    return spark.createDataFrame(pd.concat(parts), f"image_id long, r int, c int, red {kind}, green {kind}, blue {kind}")


def _explode_images(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            h, w, k = row["height"], row["width"], row["nChannels"]
            a = np.frombuffer(row["data"], np.uint8).reshape(h, w, k)
            bgr = [a[:, :, 0]] * 3 if k == 1 else [a[:, :, i] for i in range(3)]
            columns = [np.full(h * w, row["image_id"], np.int64), np.repeat(np.arange(1, h + 1, dtype=np.int32), w), np.tile(np.arange(1, w + 1, dtype=np.int32), h), *(np.ascontiguousarray(bgr[i]).ravel().astype(np.int32) for i in (2, 1, 0))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["image_id", "r", "c", "red", "green", "blue"])


def from_files(spark: SparkSession, path: str, id_pattern: str = r"([0-9]+)[^/]*$") -> DataFrame:
    """PNG or JPEG files; the id is the number in the file's name. Files of other depths are an error."""
    images = spark.read.format("image").load(path).select("image.*")
    images = images.select(F.regexp_extract("origin", id_pattern, 1).cast("long").alias("image_id"), "height", "width", "nChannels", "data")
    checked = images.withColumn("nChannels", F.when(F.col("nChannels").isin(1, 3, 4), F.col("nChannels")).otherwise(F.raise_error(F.lit("InvalidImage: input must be an RGB or grayscale image"))))
    return checked.mapInArrow(_explode_images, "image_id long, r int, c int, red int, green int, blue int")


def ids_from_text(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines don't count."""
    return spark.read.text(path).select(F.trim("value").alias("v")).where("v <> ''").select(F.col("v").cast("long").alias("image_id")).distinct()


def only(pixels: DataFrame, ids: DataFrame | Iterable[int]) -> DataFrame:
    """The images in a list of ids."""
    if isinstance(ids, DataFrame):
        return pixels.join(ids.select("image_id"), "image_id", "left_semi")
    return pixels.where(F.col("image_id").isin([int(i) for i in ids]))


def edge_maps(pixels: DataFrame, mode: str = "sobel", edges: DataFrame | None = None) -> DataFrame:
    """``pixels`` with ``edge``: ``sobel`` is computed, ``external`` comes from ``edges``.

    ``edges`` has ``edge``, or three channels that become luma. Sizes must agree image by image.
    """
    if mode == "sobel":
        return sobel(pixels)
    if mode != "external":
        raise InvalidEdgeMode(f"unknown edge mode {mode!r}")
    if edges is None:
        raise MissingEdgeMap("the external edge mode needs an edge map")
    if "edge" not in edges.columns:
        from sparkseg.functions.color import gray

        edges = edges.withColumn("edge", gray(F.col("red"), F.col("green"), F.col("blue")))
    size = lambda df: df.groupBy("image_id").agg(F.struct(F.max("r"), F.max("c"), F.count("*")).alias("s"))
    bad = size(pixels).alias("p").join(size(edges).alias("e"), "image_id", "left").where(~F.col("p.s").eqNullSafe(F.col("e.s"))).head(1)
    if bad:
        raise EdgeSizeMismatch(f"edge map and image {bad[0][0]} differ in height or width")
    from sparkseg.operators.channels import external_edges

    return external_edges(pixels, edges)
