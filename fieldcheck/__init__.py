"""Data-quality checks for periodically uploaded measurement records, as Spark jobs."""

__version__ = "0.1.0"
