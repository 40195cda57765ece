"""Small images with results worked out by hand, and errors."""

import math

import numpy as np
import pytest

from sparkseg import errors
from sparkseg.operators import assign, channels, connectivity, metrics, regions, seeds
from sparkseg.plans import segment as plan
from sparkseg.sources import raster


def image(spark, rows, name="label", image_id=1):
    data = [(image_id, r + 1, c + 1, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(data, f"image_id long, r int, c int, {name} {'double' if isinstance(rows[0][0], float) else 'int'}")


def grid(df, name):
    cells = {(r.r, r.c): r[name] for r in df.collect()}
    return [[cells[r, c] for c in range(1, max(x for _, x in cells) + 1)] for r in range(1, max(y for y, _ in cells) + 1)]


def test_adjacency_and_compaction(spark):
    found = {(r.src, r.dst): r.w for r in regions.adjacency(image(spark, [[1, 1, 2], [1, 3, 2]])).collect()}
    assert found == {(1, 2): 1, (2, 1): 1, (1, 3): 2, (3, 1): 2, (2, 3): 1, (3, 2): 1}
    assert grid(regions.compact(image(spark, [[0, 5, 5, 9]])), "label") == [[1, 2, 2, 3]]


def pairs(spark, labels, truth):
    return image(spark, labels).join(image(spark, truth, "region"), ["image_id", "r", "c"])


def test_metrics(spark):
    assert metrics.achievable_accuracy(pairs(spark, [[1, 1], [2, 2]], [[7, 7], [7, 8]])).first().asa == 0.75
    both = pairs(spark, [[1, 2, 2]] * 3, [[1, 2, 2], [1, 2, 2], [3, 3, 3]])
    masked = metrics.masks(both, [(3, 3)])
    assert metrics.boundary_recall(masked).first().br == 0.75
    assert metrics.instance_recall(masked).first().ibr == pytest.approx(7 / 9)
    classes = {r["class"]: r["count"] for r in metrics.recall_classes(masked).groupBy("class").count().collect()}
    assert classes == {"recalled": 6, "missed": 2, "none": 1}


def test_constant_annotation_has_no_recall(spark):
    from pyspark.sql import functions as F

    labels = image(spark, [[1, 2], [1, 2]])
    truth = image(spark, [[1, 1], [1, 1]], "region").withColumn("gt_idx", F.lit(1)).unionByName(image(spark, [[1, 2], [1, 2]], "region").withColumn("gt_idx", F.lit(2)))
    rows = {r.ground_truth: (r.br, r.ibr) for r in plan.evaluate(labels, truth).collect()}
    assert rows["2"] == (1.0, 1.0) and all(math.isnan(x) for x in (*rows["1"], *rows["mean"]))
    with pytest.raises(errors.SizeMismatch):
        plan.evaluate(labels, image(spark, [[1, 2, 3]], "region").withColumn("gt_idx", F.lit(1)))


def test_percentile_is_the_midpoint_one(spark):
    edges = image(spark, [[4.0, 1.0], [3.0, 2.0]], "edge")
    assert [channels.percentile_threshold(edges, p).first().threshold for p in (60, 0, 100)] == pytest.approx([2.9, 1, 4])


def test_weights(spark):
    root = math.sqrt
    values = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, root(2), 2.0, 2.0), (2, 0.0, 0.5, 0.5), (2, 1.0, 0.5, 0.5), (3, 0.0, 0.0, 0.5), (3, 1.0, 2.0, 0.5)], "image_id long, l double, a double, b double")
    found = {r.image_id: (r.alpha, r.beta, r.gamma) for r in channels.channel_weights(values).collect()}
    assert found[1] == pytest.approx((0.5, 2.5, 0.0))
    assert found[2] == pytest.approx((1, 1, 1))
    assert sum(found[3]) == pytest.approx(3)


def test_sobel_continues_the_border(spark):
    flat = raster.from_arrays(spark, {1: np.full((3, 4), 9)})
    assert {r.edge for r in channels.sobel(flat).collect()} == {0.0}
    step = raster.from_arrays(spark, {1: np.array([[0, 0, 100, 100]] * 3)})
    assert grid(channels.sobel(step), "edge") == [[0.0, 400.0, 400.0, 0.0]] * 3


def test_components_by_first_pixel(spark):
    parts = connectivity.with_components(image(spark, [[1, 2, 1], [2, 1, 1], [3, 3, 2]]))
    assert grid(parts, "comp") == [[0, 1, 0], [1, 0, 0], [2, 2, 3]]


def test_unique_maximum(spark):
    psi = image(spark, [[1.0, 5.0, 1.0, 1.0], [1.0, 1.0, 1.0, 7.0], [5.0, 1.0, 7.0, 1.0]], "psi")
    assert grid(seeds.unique_maximum(psi, 1, "top"), "top") == [[False, True, False, False], [False, False, False, False], [True, False, False, False]]


def noise(spark, n=1, shape=(40, 30)):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (shape[0] // 5, shape[1] // 5, 3)).repeat(5, 0).repeat(5, 1)
    return raster.from_arrays(spark, {i: np.clip(base + rng.integers(-30, 30, base.shape), 0, 255) for i in range(n)})


def test_grid_join_is_the_range_join(spark):
    chosen, weights, _ = plan.elected(noise(spark))
    chosen = chosen.persist()
    table = seeds.numbered(chosen)
    a, b = (sorted(map(tuple, assign.nearest_seed(chosen, table, weights, grid=g).collect())) for g in (True, False))
    assert a == b and len(a) == 1200


def test_segment_levels(spark):
    found = plan.segment(noise(spark, 2), [6, 12])
    info = {r.image_id: r for r in found.info().collect()}
    assert all(list(r.target_counts) == [12, 6] and list(r.actual_counts) == [12, 6] for r in info.values())
    maps = found.label_maps().groupBy("image_id", "level").count().collect()
    assert {(r.image_id, r.level, r["count"]) for r in maps} == {(i, t, 1200) for i in (0, 1) for t in (6, 12)}


def test_typed_errors(spark):
    px = noise(spark)
    with pytest.raises(errors.InvalidImage):
        raster.from_arrays(spark, {1: np.zeros((2, 2, 2))})
    with pytest.raises(errors.InvalidEdgeMode):
        raster.edge_maps(px, "other")
    with pytest.raises(errors.MissingEdgeMap):
        raster.edge_maps(px, "external")
    with pytest.raises(errors.EdgeSizeMismatch):
        raster.edge_maps(px, "external", image(spark, [[1.0, 2.0]], "edge", 0))
    with pytest.raises(errors.NoSeeds):
        plan.prepare(raster.from_arrays(spark, {1: np.zeros((2, 2))}))


def test_overlay_and_display(spark):
    px = raster.from_arrays(spark, {1: np.array([[0.0, 0.5, 2.0]])})
    assert grid(metrics.display_bytes(px, "float"), "red") == [[0, 1, 2]]
    painted = metrics.overlay(raster.from_arrays(spark, {1: np.array([[1, 1, 1]])}).join(image(spark, [[1, 1, 2]]), ["image_id", "r", "c"]))
    assert grid(painted, "red") == [[1, 255, 255]] and grid(painted, "green") == [[1, 0, 0]]


def test_image_files_and_ids(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes([10, 20, 30, 40, 50, 60]) for _ in range(2))
    (tmp_path / "img_17.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    got = sorted(map(tuple, raster.from_files(spark, str(tmp_path / "*.png")).collect()))
    assert got == [(17, 1, 1, 10, 20, 30), (17, 1, 2, 40, 50, 60), (17, 2, 1, 10, 20, 30), (17, 2, 2, 40, 50, 60)]
    (tmp_path / "ids.txt").write_text("3\n\n5\n3\n")
    assert sorted(r.image_id for r in raster.ids_from_text(spark, str(tmp_path / "ids.txt")).collect()) == [3, 5]


def mat_bytes(cells):
    import struct
    import zlib

    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def matrix(flags, shape, name, body):
        return element(14, element(6, struct.pack("<II", flags, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name) + body)

    structs = [matrix(2, (1, 1), b"", element(5, struct.pack("<i", 16)) + element(1, b"Segmentation".ljust(16, b"\0")) + matrix(11, c.shape, b"", element(4, c.astype("<u2").tobytes(order="F")))) for c in cells]
    packed = zlib.compress(matrix(1, (1, len(cells)), b"groundTruth", b"".join(structs)))
    return b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + struct.pack("<II", 15, len(packed)) + packed


def test_ground_truth_from_mat_files(spark, tmp_path):
    from sparkseg.sources import annotations

    cells = [np.array([[1, 2], [3, 4], [5, 6]]), np.array([[7, 7], [7, 8], [9, 9]])]
    (tmp_path / "31_gt.mat").write_bytes(mat_bytes(cells))
    want = {(31, k, r + 1, c + 1, int(v)) for k, a in enumerate(cells, 1) for (r, c), v in np.ndenumerate(a)}
    assert {tuple(r) for r in annotations.from_mat_files(spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in annotations.to_frame(spark, {31: {"groundTruth": [{"Segmentation": a} for a in cells]}}).collect()} == want
    for bad in ({"x": 1}, [{"x": 1}], "text"):
        with pytest.raises(errors.InvalidGroundTruth):
            annotations.unpack(bad)


def test_images_as_a_stream(spark, tmp_path):
    from sparkseg.streaming import images

    noise(spark, 1).write.parquet(str(tmp_path / "in"))
    images.segment_stream(spark, images.pixel_stream(spark, str(tmp_path / "in")), [8], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1200
