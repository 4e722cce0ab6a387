"""Raster engine: sources."""
