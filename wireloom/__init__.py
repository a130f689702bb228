"""Network-flow analytics on Spark: packets -> sessions -> profiles -> protocol models."""

__version__ = "0.1.0"
