"""Colour expressions: sRGB (0 to 255) to CIE Lab under D65, and luma."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The public sRGB and D65 definitions.
MATRIX = (
    (0.4124564, 0.3575761, 0.1804375),
    (0.2126729, 0.7151522, 0.0721750),
    (0.0193339, 0.1191920, 0.9503041),
)
WHITE = (0.9504, 1.0, 1.0888)
KNEE = 0.008856451679
SLOPE = 7.787037037
SHIFT = 0.137931034483
LUMA = (0.298936, 0.587043, 0.114021)


def linear(channel: Column) -> Column:
    x = channel.cast("double") / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def lab(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    rgb = [linear(ch) for ch in (red, green, blue)]
    xyz = [(m[0] * rgb[0] + m[1] * rgb[1] + m[2] * rgb[2]) / w for m, w in zip(MATRIX, WHITE)]
    f = [F.when(t > KNEE, F.cbrt(t)).otherwise(SLOPE * t + SHIFT) for t in xyz]
    return 116.0 * f[1] - 16.0, 500.0 * (f[0] - f[1]), 200.0 * (f[1] - f[2])


def gray(red: Column, green: Column, blue: Column) -> Column:
    """Luma of bytes, rounded to a byte."""
    return F.round(LUMA[0] * red + LUMA[1] * green + LUMA[2] * blue).cast("int")
