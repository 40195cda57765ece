"""Segmentation of images as they arrive: files are a stream, each micro-batch a batch of images."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkseg.options import Options
from sparkseg.plans.segment import segment

PIXELS = "image_id long, r int, c int, red int, green int, blue int"


def segment_stream(spark: SparkSession, pixels: DataFrame, targets: Iterable[int], out: str, checkpoint: str, options: Options = Options(), after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Label maps of each arriving image as Parquet by image and level.

    A micro-batch must hold whole images (one file an image); a batch that runs twice replaces its own
    folder, so each image is written once.
    """
    wanted = list(targets)

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            maps = segment(batch, wanted, options).label_maps()
            maps.write.mode("overwrite").partitionBy("level").parquet(f"{out}/batch={number}")
        if after:
            after(number)

    return pixels.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pixel_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of ``pixels`` rows, as they appear in a folder."""
    return spark.readStream.schema(PIXELS).parquet(folder).withColumn("image_id", F.col("image_id").cast("long"))
