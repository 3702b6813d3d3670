"""Queries over the driver tables, by capability family. Importing the modules registers them."""

from tessella.plans import decisions, extras, labels, rasters, selection, statistics, vectors  # noqa: F401
