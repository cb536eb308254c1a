"""Property-graph analytics on Spark DataFrames."""

from graphloom.model import PropertyGraph

__all__ = ["PropertyGraph"]
