"""Spatial disaggregation and areal interpolation as Spark plans."""
