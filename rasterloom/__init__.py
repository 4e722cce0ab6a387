"""Raster phase mapping on Spark: pixels, masks, features, labels and registries are DataFrames."""
