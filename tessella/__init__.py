"""Spark-native label-quality analytics: relational, raster, vector and decision operators over DataFrames."""
