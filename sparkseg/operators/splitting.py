"""Splitting of regions where an image has fewer of them than are asked for.

The largest region is cut in two again and again. Regions keep their numbers and parts get the next ones, so
a region above ``t`` belonged, when there were ``t`` regions, to the first of its parents that isn't.
One call handles the pixels of an image; only images with too few regions go through it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def _grown(starts: list[tuple[int, int]], inside: set[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Pixels of ``inside`` in the order in which they are reached, with the number of the start that came first."""
    found = {p: i for i, p in enumerate(starts)}
    queue = list(found)
    for r, c in queue:
        for dr, dc in AROUND:
            p = (r + dr, c + dc)
            if p in inside and p not in found:
                found[p] = found[r, c]
                queue.append(p)
    return found


def halves(pixels: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Two connected parts of a connected region, grown from pixels far from each other; the first pixel is in the first.

    Of a region that isn't connected the first part is what the first pixel reaches.
    """
    inside = set(pixels)
    reached = _grown(pixels[:1], inside)
    if len(reached) == len(pixels):
        a = list(reached)[-1]
        reached = _grown([a, list(_grown([a], inside))[-1]], inside)
    own = reached[pixels[0]]
    return [p for p in pixels if reached.get(p) == own], [p for p in pixels if reached.get(p) != own]


def split(pixels: pd.DataFrame, least: int) -> pd.DataFrame:
    """``pixels(r, c, label)`` with labels 1..K: labels 1..``least`` (or a pixel each) and ``parent``, 0 up to K."""
    pixels = pixels.sort_values(["c", "r"], kind="stable")
    parts = {int(k): list(zip(p["r"].tolist(), p["c"].tolist())) for k, p in pixels.groupby("label")}
    parents = dict.fromkeys(parts, 0)
    heap = [(-len(p), k) for k, p in parts.items()]
    heapq.heapify(heap)
    while len(parts) < least and -heap[0][0] > 1:
        _, k = heapq.heappop(heap)
        new = len(parts) + 1
        parts[k], parts[new] = halves(parts[k])
        parents[new] = k
        for x in (k, new):
            heapq.heappush(heap, (-len(parts[x]), x))
    rows = [(r, c, k, parents[k]) for k, p in parts.items() for r, c in p]
    return pd.DataFrame(rows, columns=["r", "c", "label", "parent"])


def ancestors(parent: np.ndarray, count: int) -> np.ndarray:
    """For labels 1..n with their parents: the label of each, from 1, when there were ``count`` regions."""
    at = np.arange(1, len(parent) + 1)
    while (over := at > count).any():
        at[over] = parent[at[over] - 1]
    return at


def refined(labels: DataFrame, least: int) -> DataFrame:
    """``labels`` with ``parent``; regions of images with fewer than ``least`` are split."""
    short = labels.groupBy("image_id").agg(F.max("label").alias("_k")).where(F.col("_k") < least).select("image_id")

    def run(key, pixels):
        return split(pixels, least).assign(image_id=key[0])

    parts = labels.join(short, "image_id", "left_semi").select("image_id", "r", "c", "label").groupBy("image_id").applyInPandas(run, "image_id long, r int, c int, label int, parent int")
    cut = labels.drop("label").join(parts, ["image_id", "r", "c"])
    return labels.join(short, "image_id", "left_anti").withColumn("parent", F.lit(0)).unionByName(cut)
