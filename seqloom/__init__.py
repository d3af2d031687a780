"""Exact multi-pattern search over sequence-like records, expressed as Spark plans."""

__version__ = "0.1.0"
