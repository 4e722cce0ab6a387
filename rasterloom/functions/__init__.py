"""Raster engine: functions."""
