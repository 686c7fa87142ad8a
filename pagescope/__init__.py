"""Parquet internals as Spark relations: footers, pages, indexes, values and nested assembly."""

__version__ = "0.2.0"
