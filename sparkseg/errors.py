"""Typed errors; ``code`` is the stable identifier of each."""

from __future__ import annotations


class SegmentationError(ValueError):
    code = "Segmentation"

    def __init__(self, message: str):
        super().__init__(f"{self.code}: {message}")


class TargetAboveFoundation(SegmentationError):
    code = "TargetAboveFoundation"


class TargetNotReached(SegmentationError):
    code = "TargetNotReached"


class InvalidImage(SegmentationError):
    code = "InvalidImage"


class EdgeSizeMismatch(SegmentationError):
    code = "EdgeSizeMismatch"


class SizeMismatch(SegmentationError):
    code = "SizeMismatch"


class MissingEdgeMap(SegmentationError):
    code = "MissingEdgeMap"


class InvalidEdgeMode(SegmentationError):
    code = "InvalidEdgeMode"


class InvalidGroundTruth(SegmentationError):
    code = "InvalidGroundTruth"


class MissingImage(SegmentationError):
    code = "MissingImage"


class NoSeeds(SegmentationError):
    code = "NoSeeds"


class InvalidLabels(SegmentationError):
    code = "InvalidLabels"


class InvalidOption(SegmentationError):
    code = "InvalidOption"
