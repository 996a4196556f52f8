"""Spark-first screening analytics: relational cleaning, exact search, statistics, sampling and text scans."""

__version__ = "0.1.0"
