"""Composite entry points: prepare, segment (plain or size-constrained), evaluate."""

from __future__ import annotations

import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseg.errors import NoSeeds, SizeMismatch
from sparkseg.functions.lineage import cut
from sparkseg.functions.neighbours import extent
from sparkseg.operators import assign, channels, connectivity, merging, metrics, regions, seeds, splitting
from sparkseg.options import Options, targets_of
from sparkseg.sources.raster import edge_maps


@dataclass
class Prepared:
    """Relations of the foundation stage; ``labels`` has the pixels with ``l, a, b, edge, psi, is_seed, label``."""

    labels: DataFrame
    weights: DataFrame
    thresholds: DataFrame
    seeds: DataFrame
    options: Options

    def info(self) -> DataFrame:
        """A row per image: counts, threshold, weights and options."""
        counts = self.labels.groupBy("image_id").agg(F.max("label").alias("initial_superpixels"), F.count_if("is_seed").alias("seed_count"))
        out = counts.join(self.thresholds, "image_id").join(self.weights, "image_id").withColumnRenamed("threshold", "edge_threshold")
        o = self.options
        return out.withColumns({"edge_percentile": F.lit(float(o.edge_percentile)), "spatial_weight": F.lit(float(o.spatial_weight)), "search_radius_multiplier": F.lit(float(o.search_radius_multiplier))})


def image_sizes(pixels: DataFrame) -> list[tuple[int, int]]:
    """The distinct sizes of a batch (bounded by the formats in use, not by the number of images)."""
    return [(r.rows, r.cols) for r in extent(pixels).select("rows", "cols").distinct().collect()]


def elected(pixels: DataFrame, options: Options = Options(), edge_mode: str = "sobel", edges: DataFrame | None = None, radii: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pixels with channels, edge, density and ``is_seed``; channel weights; thresholds.

    ``radii`` are those of the format that all images have, also one cut short; else each image's size gives them.
    """
    sizes = [] if radii else image_sizes(pixels)
    values = cut(channels.scaled(channels.lab_channels(edge_maps(pixels, edge_mode, edges))).join(extent(pixels), "image_id"))
    weights = cut(channels.channel_weights(values, options.max_l))
    thresholds = cut(channels.percentile_threshold(values, options.edge_percentile))
    dense = seeds.break_ties(seeds.density(values, weights), options.random_seed)
    return seeds.elect(dense, thresholds, sizes, radii), weights, thresholds


def prepare(pixels: DataFrame, options: Options = Options(), edge_mode: str = "sobel", edges: DataFrame | None = None, radii: tuple[int, int] | None = None, least: int | None = None) -> Prepared:
    """Foundation regions: connected, numbered 1..K per image.

    With ``least`` no image stops the others: one without seeds is a region, and one of fewer than ``least``
    regions has them split; ``labels`` then has the ``parent`` of each part.
    """
    chosen, weights, thresholds = elected(pixels, options, edge_mode, edges, radii)
    chosen = cut(chosen)
    table = cut(seeds.numbered(chosen))
    bare = chosen.groupBy("image_id").agg(F.max("is_seed").alias("any")).where("not any").head(1) if least is None else []
    if bare:
        raise NoSeeds(f"image {bare[0].image_id} has no seeds")
    first = assign.nearest_seed(chosen, table, weights, options.spatial_weight, options.search_radius_multiplier)
    joined = chosen.join(first, ["image_id", "r", "c"])
    labels = cut(regions.compact(connectivity.repaired(cut(joined), weights)))
    return Prepared(labels if least is None else cut(splitting.refined(labels, least)), weights, thresholds, table, options)


def hierarchy(prepared: Prepared, targets: Iterable[int], sized: bool = False) -> DataFrame:
    """``merging.SCHEMA``: for each requested count, the region of each foundation region.

    Above the foundation, where its regions were split, a level has the parts that there were at its count.
    """
    wanted = targets_of(targets)
    node = regions.nodes(prepared.labels).join(prepared.weights, "image_id")
    if "parent" in prepared.labels.columns:
        node = node.join(prepared.labels.select("image_id", "label", "parent").distinct(), ["image_id", "label"])
    edges = regions.adjacency(prepared.labels).select(F.col("image_id").alias("image"), *(F.col(x).alias(x) for x in ("src", "dst", "w")))  # names of its own
    return node.groupBy("image_id").cogroup(edges.groupBy("image")).applyInPandas(merging.kernel(wanted, prepared.options, sized), merging.SCHEMA)


@dataclass
class Segmentation:
    prepared: Prepared
    levels: DataFrame  # merging.SCHEMA
    sized: bool
    seconds: float

    def label_maps(self) -> DataFrame:
        """``image_id, level, r, c, label``: a map for each requested count."""
        base = self.prepared.labels.select("image_id", "r", "c", F.col("label").alias("base_label"))
        return base.join(self.levels.select("image_id", F.col("target").alias("level"), "base_label", "label"), ["image_id", "base_label"]).drop("base_label")

    def info(self) -> DataFrame:
        per = self.levels.groupBy("image_id").agg(
            F.sort_array(F.collect_set("target"), asc=False).alias("target_counts"), F.transform(F.sort_array(F.collect_set(F.struct("target", "actual")), asc=False), lambda x: x["actual"]).alias("actual_counts"),
            F.max("rounds").alias("merge_rounds"), F.max("fell_back").alias("used_original_fallback"),
        )
        o = self.prepared.options
        out = self.prepared.info().join(per, "image_id").withColumns({"method": F.lit("size_constraint" if self.sized else "original"), "runtime_seconds": F.lit(self.seconds)})
        return out.withColumns({"lambda_size": F.lit(float(o.lambda_size)), "size_tau": F.lit(float(o.size_tau))}) if self.sized else out.drop("used_original_fallback")


def segment(pixels: DataFrame, targets: Iterable[int], options: Options = Options(), edge_mode: str = "sobel", edges: DataFrame | None = None, sized: bool = False) -> Segmentation:
    began = time.perf_counter()
    wanted = targets_of(targets)
    ready = prepare(pixels, options, edge_mode, edges)
    levels = hierarchy(ready, wanted, sized).persist()
    levels.count()
    return Segmentation(ready, levels, sized, time.perf_counter() - began)


def segment_size_constrained(pixels: DataFrame, targets: Iterable[int], options: Options = Options(), **more) -> Segmentation:
    return segment(pixels, targets, options, sized=True, **more)


def same_size(labels: DataFrame, truth: DataFrame) -> None:
    """Label map and annotation must cover the same pixels."""
    size = lambda df: df.groupBy("image_id").agg(F.struct(F.max("r"), F.max("c"), F.count("*")).alias("s"))
    bad = size(labels).alias("a").join(size(truth).alias("b"), "image_id").where("a.s <> b.s").head(1)
    if bad:
        raise SizeMismatch(f"labels and annotation of image {bad[0][0]} differ in height or width")


def evaluate(labels: DataFrame, truth: DataFrame, tolerance: int | None = None) -> DataFrame:
    """``image_id, ground_truth, br, ibr``: a row per annotation and their mean, per image.

    ``truth(image_id, gt_idx, r, c, region)``; annotations are numbered from 1. The image's size gives the
    tolerance where none is given.
    """
    sizes = [] if tolerance is not None else image_sizes(labels)
    rows = None
    for (idx,) in sorted(truth.select("gt_idx").distinct().collect()):
        one = truth.where(F.col("gt_idx") == idx).drop("gt_idx")
        same_size(labels, one)
        masked = metrics.masks(labels.select("image_id", "r", "c", "label").join(one, ["image_id", "r", "c"]), sizes, tolerance)
        row = metrics.boundary_recall(masked).join(metrics.instance_recall(masked), "image_id").withColumn("ground_truth", F.lit(str(idx)))
        rows = row if rows is None else rows.unionByName(row)
    return metrics.table(rows)


def achievable_accuracy(labels: DataFrame, truth: DataFrame) -> DataFrame:
    same_size(labels, truth)
    return metrics.achievable_accuracy(labels.select("image_id", "r", "c", "label").join(truth.select("image_id", "r", "c", "region"), ["image_id", "r", "c"]))
