"""spanforge: evidence retrieval and text-corpus processing as PySpark DataFrame operators."""

__version__ = "0.1.0"
