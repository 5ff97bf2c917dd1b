"""Spark-first engine for retrieval, citation audit and text analytics over standards corpora."""

__version__ = "0.1.0"
