"""Hand-worked cases of repair and merging, without a session."""

import numpy as np
import pandas as pd
import pytest

from sparkseg.errors import InvalidOption, TargetAboveFoundation, TargetNotReached
from sparkseg.operators.connectivity import Forest, Repair, _touching
from sparkseg.operators.merging import hierarchy_of
from sparkseg.options import Options, targets_of


def chain(values=(0, 0.1, 0.3, 0.9)):
    n = len(values)
    nodes = pd.DataFrame({"label": range(1, n + 1), "n": 1, "sum_l": values, "sum_a": 0.0, "sum_b": 0.0, "alpha": 1.0, "beta": 1.0, "gamma": 1.0})
    edges = pd.DataFrame([(i, i + 1, 1) for i in range(1, n)] + [(i + 1, i, 1) for i in range(1, n)], columns=["src", "dst", "w"])
    return nodes, edges


def partition(labels):
    names = {}
    return [names.setdefault(x, len(names)) for x in labels]


def test_plain_merge_in_two_rounds():
    found = hierarchy_of(*chain(), [2], Options(), False)
    (target, labels, round_), = found.levels
    assert (target, partition(labels), round_, found.rounds) == (2, [0, 0, 0, 1], 2, 2)
    assert list(labels + 1) == [2, 2, 2, 1]


def test_size_penalty_falls_back():
    found = hierarchy_of(*chain(), [2], Options(), True)
    assert partition(found.levels[0][1]) == [0, 0, 0, 1]
    assert found.fell_back and found.rounds == 3


def test_no_penalty_is_the_plain_rule():
    plain = hierarchy_of(*chain(), [3, 2], Options(), False)
    sized = hierarchy_of(*chain(), [3, 2], Options(lambda_size=0), True)
    assert [(t, list(m)) for t, m, _ in plain.levels] == [(t, list(m)) for t, m, _ in sized.levels]


def test_target_of_all_regions_is_dense():
    found = hierarchy_of(*chain(), [4], Options(), False)
    assert sorted(found.levels[0][1]) == [0, 1, 2, 3]


def test_targets_out_of_reach():
    with pytest.raises(TargetAboveFoundation):
        hierarchy_of(*chain(), [5], Options(), False)
    nodes, edges = chain()
    with pytest.raises(TargetNotReached):
        hierarchy_of(nodes, edges.iloc[:0], [1], Options(), False)


def test_levels_nest_on_random_grids():
    rng = np.random.default_rng(0)
    h = w = 12
    nodes = pd.DataFrame({"label": range(1, h * w + 1), "n": 5, "sum_l": rng.random(h * w) * 5, "sum_a": rng.random(h * w) * 5, "sum_b": 0.0, "alpha": 1.0, "beta": 1.5, "gamma": 0.5})
    at = np.arange(1, h * w + 1).reshape(h, w)
    pairs = [*zip(at[:, :-1].ravel(), at[:, 1:].ravel()), *zip(at[:-1].ravel(), at[1:].ravel())]
    edges = pd.DataFrame([(a, b, 3) for a, b in pairs] + [(b, a, 3) for a, b in pairs], columns=["src", "dst", "w"])
    for sized in (False, True):
        found = hierarchy_of(nodes, edges, [60, 30, 8], Options(), sized)
        maps = [m for _, m, _ in found.levels]
        assert [len(set(m)) for m in maps] == [60, 30, 8]
        assert all(sorted(set(m)) == list(range(len(set(m)))) for m in maps)
        for fine, coarse in zip(maps, maps[1:]):
            assert len({(a, b) for a, b in zip(fine, coarse)}) == len(set(fine))


def repair(rows, values=None):
    """Labels of an image after repair; components are found here by flooding."""
    image = np.array(rows)
    values = np.zeros(image.shape) if values is None else np.array(values, float)
    h, w = image.shape
    comp = -np.ones(image.shape, int)
    count = 0
    for c in range(w):
        for r in range(h):
            if comp[r, c] < 0:
                todo = [(r, c)]
                comp[r, c] = count
                while todo:
                    y, x = todo.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            v, u = y + dy, x + dx
                            if 0 <= v < h and 0 <= u < w and comp[v, u] < 0 and image[v, u] == image[y, x]:
                                comp[v, u] = count
                                todo.append((v, u))
                count += 1
    table, graph = [], set()
    for k in range(count):
        ys, xs = np.where(comp == k)
        at = lambda y, x: int(comp[y, x]) if len(ys) == 1 and 0 <= y < h and 0 <= x < w else None
        table.append((k, int(image[ys[0], xs[0]]), len(ys), values[ys, xs].sum(), 0.0, 0.0, at(ys[0] + 1, xs[0]), at(ys[0] - 1, xs[0]), at(ys[0], xs[0] + 1), at(ys[0], xs[0] - 1)))
    for r in range(h):
        for c in range(w):
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if 0 <= r + dy < h and 0 <= c + dx < w and comp[r, c] != comp[r + dy, c + dx]:
                        graph.add((int(comp[r, c]), int(comp[r + dy, c + dx])))
    frame = pd.DataFrame(table, columns=["comp", "label", "n", "sum_l", "sum_a", "sum_b", "below", "above", "right", "left"])
    fixed = Repair(frame, pd.DataFrame(sorted(graph), columns=["comp", "nbr"]), (1, 1, 1)).run()
    return np.array(fixed)[comp].tolist()


def test_lone_pixels_take_the_label_beside():
    assert repair([[1, 1, 1], [1, 2, 1], [1, 1, 1]]) == [[1] * 3] * 3
    assert repair([[1, 1, 1], [1, 1, 1], [1, 1, 2]]) == [[1] * 3] * 3


def test_small_parts_move_and_a_large_one_stays():
    small = [[1] * 3 + [2] * 4 + [1] * 2]
    assert repair(small) == [[2] * 9]
    large = [[1] * 9 + [2] * 9 + [1] * 2]
    assert repair(large) == [[1] * 9 + [2] * 11]


def test_unassigned_pixels_are_left_but_may_grow():
    assert repair([[0, 0, 1, 1, 1, 0, 0]]) == [[0, 0, 1, 1, 1, 0, 0]]
    assert repair([[0, 0, 0, 1]]) == [[0, 0, 0, 0]]


def test_runs_touch_over_corners():
    rng = np.random.default_rng(3)
    for _ in range(40):
        image = rng.integers(0, 2, (7, 6))
        runs, labels, owner = [], [], np.zeros(image.shape, int)
        for c in range(6):
            top = 0
            for r in range(7):
                if r == 6 or image[r + 1, c] != image[r, c]:
                    owner[top : r + 1, c] = len(runs)
                    runs.append((c, top, r))
                    labels.append(image[r, c])
                    top = r + 1
        forest, plain = _touching(np.array(runs), np.array(labels)), Forest(42)
        for r in range(7):
            for c in range(6):
                for dy, dx in ((1, 0), (0, 1), (1, 1), (-1, 1)):
                    if 0 <= r + dy < 7 and c + dx < 6 and image[r, c] == image[r + dy, c + dx]:
                        plain.join(r * 6 + c, (r + dy) * 6 + c + dx)
        roots = {}
        for r in range(7):
            for c in range(6):
                assert roots.setdefault(plain.root(r * 6 + c), forest.root(owner[r, c])) == forest.root(owner[r, c])
        assert len(set(roots.values())) == len(roots)


def test_targets_and_options():
    assert targets_of([400, 800, 400]) == [800, 400]
    for bad in ([0], [-1], [1.5], [float("inf")], []):
        with pytest.raises(InvalidOption):
            targets_of(bad)
    for bad in ({"spatial_weight": -1}, {"search_radius_multiplier": 0}, {"lambda_size": float("nan")}, {"size_tau": 0}):
        with pytest.raises(InvalidOption):
            Options(**bad)
