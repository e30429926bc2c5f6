"""Case-file document analytics expressed as lazy Spark DataFrame plans."""

__version__ = "0.1.0"
