"""Each pixel to the nearest seed in place and colour: a range join by grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseg.operators.channels import weighted


def search_radius(seeds: DataFrame, multiplier: float = 5) -> DataFrame:
    """``image_id, reach``: the half side of the box, over the largest seed coordinate."""
    found = seeds.groupBy("image_id").agg(F.max("radius").alias("_r"), F.max(F.greatest("r", "c")).alias("_m"))
    return found.select("image_id", (F.col("_r") * float(multiplier) / F.greatest(F.col("_m"), F.lit(1))).alias("reach"))


def nearest_seed(pixels: DataFrame, seeds: DataFrame, weights: DataFrame, spatial_weight: float = 0.5, multiplier: float = 5, grid: bool = True) -> DataFrame:
    """``image_id, r, c, label``: seeds keep their number, a pixel with no seed in its box gets 0.

    Seeds enter their own and the eight cells around, so that the join is on equality of cells; the
    strict box and the distance follow. ``grid=False`` compares all pairs of an image (for tests).
    """
    reach = search_radius(seeds, multiplier)
    cell = lambda at, size: F.floor(F.col(at) / F.col(size) / F.col("reach")).cast("int")
    s = seeds.join(reach, "image_id").select(
        "image_id", "seed_id", "reach", (F.col("r") / F.col("rows")).alias("sy"), (F.col("c") / F.col("cols")).alias("sx"),
        *(F.col(ch).alias(f"s{ch}") for ch in "lab"), cell("r", "rows").alias("gy"), cell("c", "cols").alias("gx"),
    )
    p = pixels.where("not is_seed").join(reach, "image_id").join(weights, "image_id").select("image_id", "r", "c", "l", "a", "b", "alpha", "beta", "gamma", (F.col("r") / F.col("rows")).alias("y"), (F.col("c") / F.col("cols")).alias("x"), cell("r", "rows").alias("gy"), cell("c", "cols").alias("gx"))
    on = ["image_id"]
    if grid:
        steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
        s = s.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
        s = s.withColumn("gy", F.col("gy") + F.col("_dy")).withColumn("gx", F.col("gx") + F.col("_dx"))
        on += ["gy", "gx"]
    else:
        s, p = s.drop("gy", "gx"), p.drop("gy", "gx")
    near = p.join(s, on).where((F.abs(F.col("y") - F.col("sy")) < F.col("reach")) & (F.abs(F.col("x") - F.col("sx")) < F.col("reach")))
    w = F.lit(float(spatial_weight) ** 2)
    cols = [F.col(x) for x in ("y", "x", "l", "a", "b")]
    distance = weighted(cols, [F.col(x) for x in ("sy", "sx", "sl", "sa", "sb")], [w, w, F.col("alpha"), F.col("beta"), F.col("gamma")])
    best = near.groupBy("image_id", "r", "c").agg(F.min(F.struct(distance.alias("d"), "seed_id"))["seed_id"].alias("label"))
    rest = pixels.where("not is_seed").select("image_id", "r", "c").join(best, ["image_id", "r", "c"], "left").select("image_id", "r", "c", F.coalesce("label", F.lit(0)).alias("label"))
    return rest.unionByName(seeds.select("image_id", "r", "c", F.col("seed_id").alias("label")))
