"""Cutting a plan where its steps use each other many times over."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of ``spark.checkpoint.dir``; a local one only where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sparkseg-"))
    return df.checkpoint()
