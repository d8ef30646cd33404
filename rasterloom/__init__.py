"""Raster analytics on Spark: images are pixel relations, operators are DataFrame transformations."""
