"""A snapshot engine on Spark, and operators for training data beside it."""

__version__ = "0.2.0"
