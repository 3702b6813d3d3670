"""Relational, selection, statistics, decision, vector and raster operators; each takes and returns DataFrames or columns."""
