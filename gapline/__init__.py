"""Gapline: supply-and-demand analytics as PySpark DataFrame transformations."""
