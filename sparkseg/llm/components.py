"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseg.llm.base import Scratch


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands the smallest node around it to its larger neighbours."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands the smallest node around it to its smaller neighbours and itself; ``a > b`` in each link."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    down = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` but the roots; a root is its component's smallest node.

    Each round is a written table; rounds grow as the logarithm of the longest path.
    """
    links = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        links_next = scratch.table(_small_star(_large_star(links)), "links")
        scratch.drop(links)
        links = links_next
