"""Ground truth: nested Python values, MAT v5 files and label-map sinks.

``gt(image_id, gt_idx, r, c, region)``; annotations of an image are numbered from 1.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sparkseg.errors import InvalidGroundTruth

#: MAT v5 type numbers and their numpy types.
KINDS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED, CELL, STRUCT, CHAR = 14, 15, 1, 2, 4


def _elements(data: bytes, order: str):
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # small element: size and type share four bytes
            kind, size, start, step = kind & 0xFFFF, kind >> 16, at + 4, 8
        else:
            start = at + 8
            step = 8 + (size if kind == COMPRESSED else size + -size % 8)
        yield kind, data[start : start + size]
        at += step


def _matrix(data: bytes, order: str):
    """Name and value: an array, a dict for a struct, a list for a cell."""
    parts = list(_elements(data, order))
    flags = struct.unpack_from(order + "I", parts[0][1])[0] & 0xFF
    shape = np.frombuffer(parts[1][1], order + "i4")
    name, rest = parts[2][1].decode(), parts[3:]
    if flags == CELL:
        return name, [_matrix(d, order)[1] for _, d in rest]
    if flags == STRUCT:
        width = struct.unpack_from(order + "i", rest[0][1])[0]
        names = [rest[1][1][i : i + width].split(b"\0")[0].decode() for i in range(0, len(rest[1][1]), width)]
        values = [_matrix(d, order)[1] for _, d in rest[2:]]
        rows = [dict(zip(names, values[i : i + len(names)])) for i in range(0, len(values), max(1, len(names)))]
        return name, rows[0] if len(rows) == 1 else rows
    if flags == CHAR:
        return name, "".join(map(chr, np.frombuffer(rest[0][1], order + KINDS.get(rest[0][0], "u2")))) if rest else ""
    kind, raw = rest[0] if rest else (9, b"")
    return name, np.frombuffer(raw, order + KINDS[kind]).reshape(tuple(shape), order="F")


def load_mat(data: bytes) -> dict:
    """The variables of a MAT v5 file."""
    order = "<" if data[126:128] == b"IM" else ">"
    found = {}
    for kind, body in _elements(data[128:], order):
        if kind == COMPRESSED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind == MATRIX:
            name, value = _matrix(body, order)
            found[name] = value
    return found


def unpack(truth) -> list[np.ndarray]:
    """Annotations as a list of label matrices, from a matrix, a cell of them, or structs around them."""
    if isinstance(truth, Mapping):
        if "groundTruth" in truth:
            return unpack(truth["groundTruth"])
        if "Segmentation" in truth:
            return [np.asarray(truth["Segmentation"])]
        raise InvalidGroundTruth("a struct needs the field groundTruth or Segmentation")
    if isinstance(truth, (list, tuple)):
        found = []
        for item in truth:
            if isinstance(item, Mapping):
                if "Segmentation" not in item:
                    raise InvalidGroundTruth("a cell's struct needs the field Segmentation")
                item = item["Segmentation"]
            found.append(np.asarray(item))
        return found
    array = np.asarray(truth)
    if array.ndim != 2 or array.dtype.kind not in "iufb":
        raise InvalidGroundTruth("ground truth must be a matrix, a cell or a struct")
    return [array]


def to_frame(spark: SparkSession, truths: Mapping[int, object]) -> DataFrame:
    parts = []
    for image_id, truth in truths.items():
        for k, a in enumerate(unpack(truth), 1):
            r, c = np.meshgrid(np.arange(1, a.shape[0] + 1), np.arange(1, a.shape[1] + 1), indexing="ij")
            parts.append(pd.DataFrame({"image_id": image_id, "gt_idx": k, "r": r.ravel(), "c": c.ravel(), "region": a.ravel().astype(int)}))
    return spark.createDataFrame(pd.concat(parts), "image_id long, gt_idx int, r int, c int, region int")


def from_mat_files(spark: SparkSession, path: str, id_pattern: str = r"([0-9]+)[^/]*$", variable: str = "groundTruth") -> DataFrame:
    """``gt`` from MAT files, one task a file; the id is the number in the file's name."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", id_pattern, 1).cast("long").alias("image_id"), "content")

    def run(batches):
        for pdf in batches:
            for image_id, content in zip(pdf["image_id"], pdf["content"]):
                for k, a in enumerate(unpack(load_mat(bytes(content))[variable]), 1):
                    r, c = np.meshgrid(np.arange(1, a.shape[0] + 1, dtype=np.int32), np.arange(1, a.shape[1] + 1, dtype=np.int32), indexing="ij")
                    yield pd.DataFrame({"image_id": image_id, "gt_idx": np.int32(k), "r": r.ravel(), "c": c.ravel(), "region": a.ravel().astype(np.int32)})

    return files.mapInPandas(run, "image_id long, gt_idx int, r int, c int, region int")


def write_label_maps(maps: DataFrame, path: str) -> None:
    """Label maps by image and level, so that a reader prunes to what it needs."""
    maps.write.mode("overwrite").partitionBy("image_id", "level").parquet(path)
