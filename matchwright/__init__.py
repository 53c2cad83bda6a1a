"""Talent matching and recruitment analytics on Spark DataFrames."""

from .shipping import ship

__all__ = ["ship"]
