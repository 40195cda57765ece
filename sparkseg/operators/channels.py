"""Lab channels, their scaling, channel weights, edges and the edge threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseg.functions import color
from sparkseg.functions.neighbours import across, down

#: Channels are kept to this many places, so that sums in another order give the same regions.
PLACES = 9
#: A channel whose range is below this has only rounding noise and counts as zero.
FLAT = 1e-9


def lab_channels(pixels: DataFrame) -> DataFrame:
    l, a, b = color.lab(F.col("red"), F.col("green"), F.col("blue"))
    return pixels.withColumn("l", l).withColumn("a", a).withColumn("b", b)


def scaled(values: DataFrame) -> DataFrame:
    """L over its maximum; A and B less their minimum over what is then their maximum; per image."""
    ends = values.groupBy("image_id").agg(F.max("l").alias("_l1"), *(f("a").alias(n) for f, n in ((F.min, "_a0"), (F.max, "_a1"))), *(f("b").alias(n) for f, n in ((F.min, "_b0"), (F.max, "_b1"))))
    share = lambda x, d: F.round(F.when(d < FLAT, 0.0).otherwise(x / d), PLACES)
    joined = values.join(ends, "image_id")
    joined = joined.withColumn("l", share(F.col("l"), F.col("_l1")))
    for ch in ("a", "b"):
        joined = joined.withColumn(ch, share(F.col(ch) - F.col(f"_{ch}0"), F.col(f"_{ch}1") - F.col(f"_{ch}0")))
    return joined.drop("_l1", "_a0", "_a1", "_b0", "_b1")


def channel_weights(values: DataFrame, max_l: float = 1) -> DataFrame:
    """``image_id, alpha, beta, gamma``, summing to 3, from the channels' sample variances.

    One of A and B flat: the other gets all that alpha leaves. Both flat: they share it and alpha is ``max_l``.
    """
    variance = lambda ch: F.coalesce(F.var_samp(ch), F.lit(0.0))
    var = values.groupBy("image_id").agg(*(variance(ch).alias(f"v{ch}") for ch in "lab"))
    alpha = F.when(F.col("va") + F.col("vb") > 0, F.least(2 * F.col("vl") / (F.col("va") + F.col("vb")), F.lit(float(max_l)))).otherwise(float(max_l))
    var = var.withColumn("alpha", alpha).withColumn("left", 3 - F.col("alpha"))
    both = (F.col("va") > 0) & (F.col("vb") > 0)
    rest = F.when(both, F.col("left") / (F.ln(F.greatest("va", "vb") / F.when(both, F.least("va", "vb")).otherwise(1.0)) + 1)).when((F.col("va") == 0) & (F.col("vb") == 0), F.col("left") / 2).otherwise(0.0)
    var = var.withColumn("rest", rest)
    # the channel of larger variance gets the rest; with one flat channel the rest is 0
    beta = F.when(F.col("vb") > F.col("va"), F.col("left") - F.col("rest")).otherwise(F.col("rest"))
    gamma = F.when(F.col("vb") > F.col("va"), F.col("rest")).otherwise(F.col("left") - F.col("rest"))
    return var.select("image_id", *(F.round(x, PLACES).alias(n) for x, n in ((F.col("alpha"), "alpha"), (beta, "beta"), (gamma, "gamma"))))


def sobel(pixels: DataFrame) -> DataFrame:
    """Adds ``edge``, the Sobel magnitude of the luma; the border is continued outwards."""
    g = pixels.withColumn("_g", color.gray(F.col("red"), F.col("green"), F.col("blue")).cast("double"))
    here = F.col("_g")
    above, below = (F.coalesce(f("_g").over(down()), here) for f in (F.lag, F.lead))
    g = g.withColumn("_smooth", above + 2 * here + below).withColumn("_rise", above - below)
    left, right = (F.coalesce(f("_smooth").over(across()), F.col("_smooth")) for f in (F.lag, F.lead))
    ahead = lambda f: F.coalesce(f("_rise").over(across()), F.col("_rise"))
    gx, gy = left - right, ahead(F.lag) + 2 * F.col("_rise") + ahead(F.lead)
    return g.withColumn("edge", F.sqrt(gx * gx + gy * gy)).drop("_g", "_smooth", "_rise")


def percentile_threshold(edges: DataFrame, percentile: float) -> DataFrame:
    """``image_id, threshold``: the midpoint percentile, rank p n / 100 + 0.5 between neighbours.

    Values are counted first, so no task holds more than an image's distinct values.
    """
    counts = edges.groupBy("image_id", "edge").agg(F.count("*").alias("_k"))
    by_value = Window.partitionBy("image_id").orderBy("edge")
    upto = F.sum("_k").over(by_value.rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_last", upto).withColumn("_n", F.sum("_k").over(Window.partitionBy("image_id")))
    rank = F.least(F.greatest(F.lit(float(percentile)) / 100.0 * F.col("_n") + 0.5, F.lit(1.0)), F.col("_n").cast("double"))
    counts = counts.withColumn("_rank", rank)
    value_at = lambda rank: F.min(F.when(F.col("_last") >= rank, F.col("edge")))
    ends = counts.groupBy("image_id").agg(value_at(F.floor("_rank")).alias("lo"), value_at(F.ceil("_rank")).alias("hi"), F.max("_rank").alias("rank"))
    return ends.select("image_id", (F.col("lo") + (F.col("rank") - F.floor("rank")) * (F.col("hi") - F.col("lo"))).alias("threshold"))


def external_edges(pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """``pixels`` with the ``edge`` of another relation on the same pixels."""
    return pixels.join(edges.select("image_id", "r", "c", F.col("edge").cast("double").alias("edge")), ["image_id", "r", "c"])


def weighted(values: list[Column], others: list[Column], weights: list[Column]) -> Column:
    """Sum of weighted squared differences, from left to right."""
    total = None
    for x, y, w in zip(values, others, weights):
        term = w * (x - y) * (x - y)
        total = term if total is None else total + term
    return total
