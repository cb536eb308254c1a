"""Graphs and queries over the benchmark tables."""
