"""Raster engine: plans."""
