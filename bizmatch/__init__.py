"""bizmatch: record linkage of companies on the PySpark DataFrame API."""

__version__ = "0.1.0"
