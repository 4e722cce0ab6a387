"""Raster engine: operators."""
