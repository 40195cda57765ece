"""Greedy merging of regions along ascending density, in rounds, down to requested counts.

One call handles all rounds of an image on its node and edge tables; sums of members and common
boundaries add up, so later rounds never see pixels again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from sparkseg.errors import TargetAboveFoundation, TargetNotReached
from sparkseg.operators.regions import EPSILON
from sparkseg.operators.splitting import ancestors
from sparkseg.options import Options


@dataclass
class Graph:
    n: np.ndarray
    sums: np.ndarray
    edges: dict[tuple[int, int], int]  # i < j: boundary length

    def contracted(self, part: np.ndarray) -> Graph:
        k = int(part.max()) + 1
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, 3))
        np.add.at(n, part, self.n)
        np.add.at(sums, part, self.sums)
        edges: dict[tuple[int, int], int] = {}
        for (i, j), w in self.edges.items():
            a, b = int(part[i]), int(part[j])
            if a != b:
                key = (a, b) if a < b else (b, a)
                edges[key] = edges.get(key, 0) + w
        return Graph(n, sums, edges)


@dataclass
class Round:
    """What one round needs of its graph: means, density, local maxima, the median gap."""

    graph: Graph
    weights: np.ndarray
    floor: bool
    around: list[list[int]] = field(init=False)

    def __post_init__(self):
        g, k = self.graph, len(self.graph.n)
        self.mean = g.sums / (g.n[:, None] + 0.0001)
        self.around = [[] for _ in range(k)]
        self.psi = np.zeros(k)
        shortest = np.full(k, np.nan)
        if g.edges:
            ij = np.array(sorted(g.edges), dtype=np.int64)
            w = np.array([g.edges[tuple(e)] for e in ij.tolist()], dtype=float)
            square = (self.mean[ij[:, 0]] - self.mean[ij[:, 1]]) ** 2
            away, away2 = np.sqrt(square @ self.weights), np.sqrt(square @ self.weights**2)
            src, length = np.concatenate([ij[:, 0], ij[:, 1]]), np.concatenate([w, w])
            border = np.bincount(src, length, k)
            mean_away = np.bincount(src, np.concatenate([away2, away2]) * (length / border[src]), k)
            degree = np.bincount(src, minlength=k)
            good = (degree > 0) & (mean_away > 0)
            self.psi[good] = degree[good] / mean_away[good]
            shortest = np.full(k, np.inf)
            np.minimum.at(shortest, src, np.concatenate([away, away]))
            shortest[np.isinf(shortest)] = np.nan
            for i, j in ij.tolist():
                self.around[i].append(j)
                self.around[j].append(i)
        self.peak = [all(self.psi[j] <= self.psi[i] for j in self.around[i]) for i in range(k)]
        known = shortest[~np.isnan(shortest)]
        self.gap = float(np.median(known)) if len(known) else math.nan
        if self.gap == 0 or math.isnan(self.gap):
            self.gap = float(known.mean()) if len(known) else math.nan
        if self.floor and (self.gap == 0 or math.isnan(self.gap)):
            self.gap = EPSILON


class Hierarchy:
    """All rounds over one image's regions (numbered from 0)."""

    def __init__(self, graph: Graph, weights, targets: list[int], options: Options, sized: bool):
        self.graph, self.weights, self.options, self.sized = graph, np.asarray(weights, float), options, sized
        self.wanted, self.pixels = list(targets), int(graph.n.sum())
        self.base = np.arange(len(graph.n))  # base region -> region of the current round
        self.levels: list[tuple[int, np.ndarray, int]] = []  # target, base region -> region, round
        self.rounds, self.fell_back = 0, False

    def run(self) -> None:
        k = len(self.graph.n)
        if self.wanted[0] > k:
            raise TargetAboveFoundation(f"a requested count exceeds the {k} foundation regions")
        while self.wanted and self.rounds < self.options.max_merge_rounds:
            self.rounds += 1
            moved = self.one_round(self.sized)
            if not moved and self.sized:
                self.fell_back = True
                moved = self.one_round(False)
                continue  # the plain rule has had its turn; the next round tries the penalty again
            if not moved:
                break
        if self.wanted:
            raise TargetNotReached(f"could not reach the target counts {self.wanted}")

    def one_round(self, sized: bool) -> bool:
        """One visit of all regions; whether labels or outstanding targets changed."""
        before = len(self.wanted)
        walk = Walk(self, Round(self.graph, self.weights, sized), sized)
        walk.run()
        if not self.wanted:
            return True
        part = walk.partition()
        changed = not np.array_equal(part, np.arange(len(part)))
        self.base = part[self.base]
        self.graph = self.graph.contracted(part)
        return changed or len(self.wanted) != before


class Walk:
    """The chains of one round."""

    def __init__(self, owner: Hierarchy, facts: Round, sized: bool):
        self.owner, self.facts, self.sized = owner, facts, sized
        k = len(facts.graph.n)
        self.done: list[list[int]] = []  # finished clusters in order of creation
        self.cluster = np.full(k, -1)  # region -> its finished cluster
        self.open = k  # regions in no finished cluster
        self.used = np.zeros(k, bool)
        self.area = facts.graph.n.astype(float)  # of a region, or of its finished cluster

    def finish(self, chain: list[int]) -> None:
        self.cluster[chain] = len(self.done)
        self.done.append(list(chain))
        self.open -= len(chain)
        if self.sized:
            self.area[chain] = self.facts.graph.n[chain].sum()

    def append(self, chain: list[int], father: int) -> None:
        c = int(self.cluster[father])
        self.done[c] += chain
        self.cluster[chain] = c
        self.open -= len(chain)
        if self.sized:
            self.area[self.done[c]] = self.facts.graph.n[self.done[c]].sum()

    def partition(self, chain: list[int] = ()) -> np.ndarray:
        """Region -> dense number: finished clusters, the chain at hand, then the untouched in order."""
        part = self.cluster.copy()
        count = len(self.done)
        if len(chain):
            part[chain] = count
            count += 1
        rest = np.flatnonzero(part < 0)
        part[rest] = count + np.arange(len(rest))
        return part

    def snapshot(self, chain: list[int] = ()) -> None:
        owner = self.owner
        owner.levels.append((owner.wanted.pop(0), self.partition(chain)[owner.base], owner.rounds))

    def count(self) -> int:
        return len(self.done) + self.open

    def run(self) -> None:
        wanted = self.owner.wanted
        for start in np.argsort(self.facts.psi, kind="stable").tolist():
            if self.used[start]:
                continue
            self.chain_from(start)
            if not wanted:
                return
            if self.count() <= wanted[0]:
                self.snapshot()
                if not wanted:
                    return

    def chain_from(self, node: int) -> None:
        facts, owner = self.facts, self.owner
        level = owner.options.series_level
        first_gate = facts.gap if level < 5 else (math.log(level) + 1) * facts.gap
        chain, linked, widest = [], set(), None
        while True:
            chain.append(node)
            self.used[node] = True
            linked.update(facts.around[node])
            if self.count() - len(chain) + 1 == owner.wanted[0]:
                self.snapshot(chain)
                if not owner.wanted:
                    return
            higher = sorted(x for x in linked if facts.psi[x] > facts.psi[node])
            if facts.peak[node] or not higher:
                return self.finish(chain)
            colour = (facts.mean[higher] - facts.mean[node]) ** 2 @ owner.weights
            if self.sized:
                colour = np.sqrt(colour)
                ratio = (facts.graph.n[chain].sum() + self.area[higher]) / (owner.pixels / owner.wanted[0])
                score = colour + owner.options.lambda_size * facts.gap * np.maximum(0, ratio - owner.options.size_tau) ** 2
                at = int(np.argmin(score))
                distance, pure = float(score[at]), float(colour[at])
            else:
                at = int(np.argmin(colour))
                distance = pure = math.sqrt(float(colour[at]))
            father = higher[at]
            if distance > owner.options.d_gap * (first_gate if widest is None else widest):
                return self.finish(chain)
            if self.used[father]:
                return self.append(chain, father)
            widest = pure if widest is None else max(widest, pure)
            node = father


SCHEMA = "image_id long, target int, actual int, base_label int, label int, round int, rounds int, fell_back boolean"


def hierarchy_of(nodes: pd.DataFrame, edges: pd.DataFrame, targets: list[int], options: Options, sized: bool) -> Hierarchy:
    """``nodes(label, n, sum_*, alpha, beta, gamma)`` with labels 1..K, ``edges(src, dst, w)``.

    With ``parent`` regions beyond the foundation are parts of split ones: they give the counts from the
    foundation's upwards, or as many regions as there are pixels; the foundation is merged for the others.
    """
    nodes = nodes.sort_values("label", kind="stable")
    pairs = {(int(a) - 1, int(b) - 1): int(w) for a, b, w in zip(edges["src"], edges["dst"], edges["w"]) if a < b}
    graph = Graph(nodes["n"].to_numpy(dtype=np.int64), nodes[["sum_l", "sum_a", "sum_b"]].to_numpy(dtype=float), pairs)
    weights = nodes[["alpha", "beta", "gamma"]].iloc[0].to_numpy(dtype=float)
    if "parent" not in nodes:
        found = Hierarchy(graph, weights, targets, options, sized)
        found.run()
        return found
    parent = nodes["parent"].to_numpy(dtype=np.int64)
    k = int((parent == 0).sum())
    root = ancestors(parent, k) - 1
    found = Hierarchy(graph.contracted(root), weights, [t for t in targets if t <= k], options, sized)
    if found.wanted:
        found.run()
    found.levels = [(t, ancestors(parent, t) - 1, 0) for t in targets if t > k] + [(t, m[root], r) for t, m, r in found.levels]
    return found


def kernel(targets: list[int], options: Options, sized: bool):
    """For cogrouped node and edge tables of an image: rows of ``SCHEMA``, a row per level and base region."""

    def run(key, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        found = hierarchy_of(nodes, edges, targets, options, sized)
        parts = [
            pd.DataFrame({"image_id": key[0], "target": t, "actual": int(m.max()) + 1, "base_label": np.arange(1, len(m) + 1), "label": m + 1, "round": r, "rounds": found.rounds, "fell_back": found.fell_back})
            for t, m, r in found.levels
        ]
        return pd.concat(parts)

    return run
