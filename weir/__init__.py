"""weir: a Spark-first engine for pipeline queries over relational and nested data."""

__version__ = "0.1.0"
