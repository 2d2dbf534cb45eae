"""Detection analytics over map tiles, as Spark DataFrame operators."""

__version__ = "0.1.0"
