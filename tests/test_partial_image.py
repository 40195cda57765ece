"""The last of the test rasters may have fewer rows than the others; its results are those of the SQL too."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkseg import queries
from sparkseg.operators import splitting
from sparkseg.operators.merging import hierarchy_of
from sparkseg.options import Options


@pytest.fixture(scope="module")
def cut_short(tmp_path_factory):
    """A folder whose only image has 40 of 250 rows."""
    folder = tmp_path_factory.mktemp("cut-short")
    duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/embeddings.parquet' where vec_id < 40) to '{folder}/embeddings.parquet' (format parquet)")
    return str(folder)


def agrees(spark, folder, name):
    found = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in found.columns)).fetchall()
    assert want and sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["hierarchy_counts", "hierarchy_nesting", "size_hierarchy_counts"])
def test_counts_above_the_foundation(spark, cut_short, name):
    agrees(spark, cut_short, name)


@pytest.mark.parametrize("name", ["seed_table", "assign_pixels", "boundary_dilated", "recall_classes", "br", "ibr", "br_ibr_table"])
def test_radii_of_the_format(spark, cut_short, name):
    agrees(spark, cut_short, name)


def test_an_image_without_seeds_is_a_region_and_split(spark, tmp_path):
    duckdb.sql(f"copy (select * from '/root/testdata/sf0.001/embeddings.parquet' where vec_id < 2) to '{tmp_path}/embeddings.parquet' (format parquet)")
    agrees(spark, str(tmp_path), "foundation")
    rows = {r.target: (r.actual, r.regions) for r in queries.hierarchy_counts(spark, str(tmp_path)).collect()}
    assert rows == {200: (128, 128), 100: (100, 100), 50: (50, 50)}  # 128 pixels are 128 regions at most


def test_parts_are_connected_and_nest():
    pixels = pd.DataFrame([(r, c, 1 if c < 4 else 2) for r in range(1, 9) for c in range(1, 7)], columns=["r", "c", "label"])
    parts = splitting.split(pixels, 11)
    assert sorted(parts["label"].unique()) == list(range(1, 12)) and len(parts) == 48
    for _, part in parts.groupby("label"):
        places = list(zip(part["r"], part["c"]))
        assert len(splitting._grown(places[:1], set(places))) == len(places)
    parent = parts.drop_duplicates("label").sort_values("label")["parent"].to_numpy()
    fine, coarse = splitting.ancestors(parent, 7), splitting.ancestors(parent, 2)
    assert len(set(fine)) == 7 and set(coarse) == {1, 2} and len(set(zip(fine, coarse))) == 7
    origin = dict(zip(zip(pixels["r"], pixels["c"]), pixels["label"]))
    assert all(coarse[k - 1] == origin[r, c] for r, c, k in zip(parts["r"], parts["c"], parts["label"]))


def test_merging_goes_on_from_the_foundation():
    nodes = pd.DataFrame({"label": range(1, 7), "n": 1, "sum_l": [0, 0.1, 0.3, 0.9, 0, 0.9], "sum_a": 0.0, "sum_b": 0.0, "alpha": 1.0, "beta": 1.0, "gamma": 1.0, "parent": [0, 0, 0, 0, 1, 4]})
    edges = [(1, 2), (2, 3), (3, 4), (1, 5), (4, 6)]
    edges = pd.DataFrame([(a, b, 1) for x in edges for a, b in (x, x[::-1])], columns=["src", "dst", "w"])
    levels = {t: m for t, m, _ in hierarchy_of(nodes, edges, [6, 5, 4, 2], Options(), False).levels}
    assert [len(set(levels[t])) for t in (6, 5, 4, 2)] == [6, 5, 4, 2]
    assert levels[5][5] == levels[5][3] and np.array_equal(levels[2][[4, 5]], levels[2][[0, 3]])
