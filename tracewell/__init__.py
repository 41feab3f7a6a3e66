"""Tracewell: validation, indexing, audit and lineage of nested provenance records on PySpark."""

__version__ = "0.1.0"
