"""Options of the segmentation and their checks."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from sparkseg.errors import InvalidOption


@dataclass(frozen=True)
class Options:
    edge_percentile: float = 80
    max_l: float = 1
    d_gap: float = 1
    random_seed: int = 0
    max_merge_rounds: int = 30
    series_level: float = 1
    spatial_weight: float = 0.5
    search_radius_multiplier: float = 5
    lambda_size: float = 2
    size_tau: float = 1.25

    def __post_init__(self):
        for name, least, strict in (("spatial_weight", 0, False), ("search_radius_multiplier", 0, True), ("lambda_size", 0, False), ("size_tau", 0, True)):
            value = getattr(self, name)
            if not math.isfinite(value) or value < least or strict and value == least:
                raise InvalidOption(f"{name} must be finite and {'above' if strict else 'at least'} {least}")


def targets_of(counts: Iterable[float]) -> list[int]:
    """Requested region counts: distinct, largest first."""
    values = list(counts)
    for v in values:
        if isinstance(v, bool) or not math.isfinite(v) or v != int(v) or v < 1:
            raise InvalidOption(f"target counts must be positive integers, not {v}")
    if not values:
        raise InvalidOption("at least one target count is needed")
    return sorted({int(v) for v in values}, reverse=True)
