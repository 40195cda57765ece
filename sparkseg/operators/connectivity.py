"""Connected components of equal labels and the sequential repair of small or stray ones.

Pixels become column runs by windows; runs are joined in one pass per image (a few numbers for each
run), and repair works on the graph of components, which is smaller still.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseg.functions.lineage import cut
from sparkseg.functions.neighbours import down, eight, with_eight


class Forest:
    """Disjoint sets with path halving and union by size."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.size = [1] * n

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            if self.size[x] < self.size[y]:
                x, y = y, x
            self.up[y] = x
            self.size[x] += self.size[y]


def _touching(run: np.ndarray, label: np.ndarray) -> Forest:
    """Runs (column, first row, last row) in order of column and row, joined with touching runs of their label."""
    forest, n = Forest(len(run)), len(run)
    edges = np.flatnonzero(np.diff(run[:, 0])) + 1
    bounds = [0, *edges.tolist(), n]
    for (a, b), (_, e) in zip(zip(bounds, bounds[1:]), zip(bounds[1:], bounds[2:])):
        if run[b, 0] != run[a, 0] + 1:
            continue
        i, j = a, b
        while i < b and j < e:
            if run[i, 1] <= run[j, 2] + 1 and run[j, 1] <= run[i, 2] + 1 and label[i] == label[j]:
                forest.join(i, j)
            if run[i, 2] < run[j, 2]:
                i += 1
            elif run[i, 2] > run[j, 2]:
                j += 1
            else:  # the later run of either column may still touch across the corner
                if i + 1 < b and run[i + 1, 1] <= run[j, 2] + 1 and label[i + 1] == label[j]:
                    forest.join(i + 1, j)
                if j + 1 < e and run[j + 1, 1] <= run[i, 2] + 1 and label[j + 1] == label[i]:
                    forest.join(i, j + 1)
                i += 1
                j += 1
    return forest


def _number_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["c", "top"], kind="stable").reset_index(drop=True)
    forest = _touching(pdf[["c", "top", "bottom"]].to_numpy(), pdf["label"].to_numpy())
    names: dict[int, int] = {}
    pdf["comp"] = [names.setdefault(forest.root(i), len(names)) for i in range(len(pdf))]
    return pdf[["image_id", "c", "top", "comp"]]


def with_components(labelled: DataFrame) -> DataFrame:
    """Adds ``comp``: eight-connected components of equal label, numbered by their first pixel."""
    starts = labelled.withColumn("_new", (F.coalesce(F.lag("label").over(down()) != F.col("label"), F.lit(True))).cast("int"))
    topped = starts.withColumn("top", F.max(F.when(F.col("_new") == 1, F.col("r"))).over(down().rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    runs = topped.groupBy("image_id", "c", "top").agg(F.max("r").alias("bottom"), F.first("label").alias("label"))
    comps = runs.groupBy("image_id").applyInPandas(_number_runs, "image_id long, c int, top int, comp int")
    return topped.join(comps, ["image_id", "c", "top"]).drop("top")


def component_table(parts: DataFrame) -> DataFrame:
    """``image_id, comp, label, n, sum_l, sum_a, sum_b`` and, for single pixels, the components around."""
    seen = with_eight(parts, F.col("comp"), "_k")
    stats = seen.groupBy("image_id", "comp").agg(
        F.first("label").alias("label"), F.count("*").alias("n"), *(F.sum(F.col(ch).cast("decimal(12,9)")).cast("double").alias(f"sum_{ch}") for ch in "lab"),
        *(F.max(f"_k_{at}").alias(name) for at, name in (("mid.down", "below"), ("mid.up", "above"), ("right.same", "right"), ("left.same", "left"))),
    )
    single = lambda name: F.when(F.col("n") == 1, F.col(name)).alias(name)
    return stats.select("image_id", "comp", "label", "n", "sum_l", "sum_a", "sum_b", *(single(x) for x in ("below", "above", "right", "left")))


def component_graph(parts: DataFrame) -> DataFrame:
    """``image_id, comp, nbr``: components that touch over an edge or a corner, each direction once."""
    seen = with_eight(parts.select("image_id", "r", "c", "comp"), F.col("comp"), "_k")
    around = F.array(*(F.col(n) for n in eight("_k")))
    return seen.select("image_id", "comp", F.explode(F.array_distinct(around)).alias("nbr")).where("nbr is not null and nbr <> comp").distinct()


class Repair:
    """Moves stray components to the nearest neighbouring label, label by label."""

    KEPT_AREA = 8

    def __init__(self, table: pd.DataFrame, graph: pd.DataFrame, weights: tuple[float, float, float]):
        table = table.sort_values("comp", kind="stable")
        self.shift = 1 if (table["label"] == 0).any() else 0
        self.label = (table["label"].to_numpy() + self.shift).tolist()
        self.area = table["n"].to_numpy().tolist()
        self.sums = table[["sum_l", "sum_a", "sum_b"]].to_numpy()
        self.weights = np.asarray(weights, dtype=float)
        self.single = {row.comp: [row.below, row.above, row.right, row.left] for row in table[table["n"] == 1].itertuples()}
        n = len(table)
        self.up = list(range(n))
        self.around: list[set[int]] = [set() for _ in range(n)]
        for a, b in zip(graph["comp"].tolist(), graph["nbr"].tolist()):
            self.around[a].add(b)
        self.of_label: dict[int, set[int]] = {}
        for k, x in enumerate(self.label):
            self.of_label.setdefault(x, set()).add(k)
        self.order: dict[int, int] = {}  # fused component -> first of its components
        self.last = max(self.label)
        totals = pd.DataFrame(self.sums).assign(k=self.label, n=self.area).groupby("k").sum()
        self.mean = {k: row[:3] / row[3] for k, row in zip(totals.index.tolist(), totals.to_numpy())}

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def neighbours(self, k: int) -> set[int]:
        self.around[k] = {self.root(x) for x in self.around[k]} - {k}
        return self.around[k]

    def move(self, k: int, label: int) -> None:
        """Give a component another label and fuse it with the components of that label around it."""
        self.of_label[self.label[k]].discard(k)
        together = [k, *sorted(x for x in self.neighbours(k) if self.label[x] == label)]
        base = max(together, key=lambda x: (self.area[x], -together.index(x)))
        first = min(together)  # components are numbered by their first pixel; the order of a label goes by it
        for x in together:
            self.of_label.setdefault(label, set()).discard(x)
        around = set().union(*(self.around[x] for x in together))
        area, sums = sum(self.area[x] for x in together), sum(self.sums[x] for x in together)
        for x in together:
            self.up[x] = base
            self.label[x] = label
        self.area[base], self.sums[base] = area, sums
        self.around[base] = {self.root(x) for x in around} - {base}
        self.of_label[label].add(base)
        self.order[base] = min(first, *(self.order.get(x, x) for x in together))

    def in_order(self, label: int) -> list[int]:
        return sorted(self.of_label.get(label, ()), key=lambda k: self.order.get(k, k))

    def run(self) -> list[int]:
        """The label of each of the original components."""
        for label in range(1 + self.shift, self.last + 1):
            parts = self.in_order(label)
            if len(parts) == 1:
                k = parts[0]
                if self.area[k] == 1:
                    beside = next((int(x) for x in self.single[k] if x is not None and x == x), None)
                    if beside is not None and self.label[self.root(beside)] != label:
                        self.move(k, self.label[self.root(beside)])
                continue
            if not parts:
                continue
            largest = max(range(len(parts)), key=lambda i: (self.area[parts[i]], -i))
            keep = parts[largest] if self.area[parts[largest]] > self.KEPT_AREA else None
            for k in parts:
                if k == keep or self.up[k] != k or self.label[k] != label:
                    continue
                labels = sorted({self.label[x] for x in self.neighbours(k)} - {0, label})
                if not labels:
                    continue
                own = self.sums[k] / self.area[k]
                away = [float(((self.mean[x] - own) ** 2 * self.weights).sum()) for x in labels]
                self.move(k, labels[int(np.argmin(away))])
        return [self.label[self.root(k)] - self.shift for k in range(len(self.label))]


def _repair(key, table: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
    weights = tuple(table[["alpha", "beta", "gamma"]].iloc[0])
    fixed = Repair(table.drop(columns=["alpha", "beta", "gamma"]), graph, weights).run()
    return pd.DataFrame({"image_id": key[0], "comp": np.arange(len(fixed)), "fixed": fixed})


def repaired(labelled: DataFrame, weights: DataFrame) -> DataFrame:
    """``labelled`` (with ``l, a, b``) with repaired labels; columns stay."""
    parts = cut(with_components(labelled))
    table = component_table(parts).join(weights, "image_id")
    graph = component_graph(parts).select(F.col("image_id").alias("image"), F.col("comp").alias("comp"), F.col("nbr").alias("nbr"))  # names of its own
    fixed = table.groupBy("image_id").cogroup(graph.groupBy("image")).applyInPandas(_repair, "image_id long, comp int, fixed int")
    return parts.join(fixed, ["image_id", "comp"]).withColumn("label", F.col("fixed")).drop("comp", "fixed")
