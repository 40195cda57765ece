"""Hierarchical region segmentation of rasters as Spark queries."""
