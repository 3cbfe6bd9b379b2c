"""Hyperdimensional analysis of large collections of small graphs, as Spark DataFrame jobs."""

__version__ = "0.1.0"
