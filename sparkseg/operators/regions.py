"""Region adjacency, node features, density of regions, compaction of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseg.functions.neighbours import across, down

EPSILON = 2.220446049250313e-16


def compact(labels: DataFrame) -> DataFrame:
    """Labels as 1, 2, ... in order, per image; ranks come from the distinct labels."""
    known = labels.select("image_id", "label").distinct()
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("label"))
    return labels.join(known.select("image_id", "label", rank.alias("_dense")), ["image_id", "label"]).withColumn("label", F.col("_dense")).drop("_dense")


def nodes(labelled: DataFrame) -> DataFrame:
    """``image_id, label, n, sum_l, sum_a, sum_b``; sums of decimals, the same in any order."""
    exact = lambda ch: F.sum(F.col(ch).cast("decimal(12,9)")).cast("double")
    return labelled.groupBy("image_id", "label").agg(F.count("*").alias("n"), *(exact(ch).alias(f"sum_{ch}") for ch in "lab"))


def features(node: DataFrame) -> DataFrame:
    """Adds the means that merging uses, each over the count plus 0.0001."""
    return node.select("*", *((F.col(f"sum_{ch}") / (F.col("n") + 0.0001)).alias(f"m{ch}") for ch in "lab"))


def adjacency(labelled: DataFrame) -> DataFrame:
    """``image_id, src, dst, w``: lengths of common four-neighbour boundaries, in both directions."""
    pairs = []
    for window in (down(), across()):
        pairs.append(labelled.select("image_id", F.col("label").alias("i"), F.lead("label").over(window).alias("j")).where("i <> j and i > 0 and j > 0"))
    both = pairs[0].unionAll(pairs[1]).groupBy("image_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.count("*").alias("w"))
    return both.select("image_id", F.explode(F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst")))).alias("e"), "w").select("image_id", "e.src", "e.dst", "w")


def edge_distances(edges: DataFrame, feature: DataFrame, weights: DataFrame) -> DataFrame:
    """Edges with ``d`` (weighted) and ``d2`` (weights squared, as region density uses it)."""
    of = lambda name, p: feature.select("image_id", F.col("label").alias(name), *(F.col(f"m{ch}").alias(f"{p}{ch}") for ch in "lab"))
    joined = edges.join(of("src", "x"), ["image_id", "src"]).join(of("dst", "y"), ["image_id", "dst"]).join(weights, "image_id")
    square = [(F.col(f"x{ch}") - F.col(f"y{ch}")) * (F.col(f"x{ch}") - F.col(f"y{ch}")) for ch in "lab"]
    w = [F.col(x) for x in ("alpha", "beta", "gamma")]
    total = lambda ws: F.sqrt(ws[0] * square[0] + ws[1] * square[1] + ws[2] * square[2])
    return joined.select("image_id", "src", "dst", "w", total(w).alias("d"), total([x * x for x in w]).alias("d2"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("image_id", F.col("src").alias("label")).agg(F.count("*").alias("degree"), F.sum("w").alias("boundary"))


def region_density(node: DataFrame, distances: DataFrame) -> DataFrame:
    """``image_id, label, psi``: degree over the boundary-weighted mean distance; 0 without either."""
    found = distances.groupBy("image_id", F.col("src").alias("label")).agg(F.count("*").alias("k"), (F.sum(F.col("d2") * F.col("w")) / F.sum("w")).alias("m"))
    return node.select("image_id", "label").join(found, ["image_id", "label"], "left").select("image_id", "label", F.coalesce(F.when(F.col("m") > 0, F.col("k") / F.col("m")), F.lit(0.0)).alias("psi"))


def region_seeds(psi: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``is_seed``: no neighbour is denser; isolated regions are seeds."""
    highest = edges.join(psi.withColumnRenamed("label", "dst"), ["image_id", "dst"]).groupBy("image_id", F.col("src").alias("label")).agg(F.max("psi").alias("_most"))
    return psi.join(highest, ["image_id", "label"], "left").select("image_id", "label", "psi", F.coalesce(F.col("_most") <= F.col("psi"), F.lit(True)).alias("is_seed"))


def nearest_distance(node: DataFrame, distances: DataFrame) -> DataFrame:
    """``image_id, label, shortest``: the least distance to a neighbour, null if isolated."""
    least = distances.groupBy("image_id", F.col("src").alias("label")).agg(F.min("d").alias("shortest"))
    return node.select("image_id", "label").join(least, ["image_id", "label"], "left")


def median_gap(shortest: DataFrame, floor: bool = False) -> DataFrame:
    """``image_id, gap``: the median of nearest distances, else their mean, else (with ``floor``) epsilon."""
    found = shortest.groupBy("image_id").agg(F.median("shortest").alias("m"), F.avg("shortest").alias("a"))
    gap = F.coalesce(F.nullif(F.col("m"), F.lit(0.0)), F.col("a"))
    return found.select("image_id", (F.coalesce(F.nullif(gap, F.lit(0.0)), F.lit(EPSILON)) if floor else gap).alias("gap"))
