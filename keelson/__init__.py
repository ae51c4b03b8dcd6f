"""keelson: a PySpark-native engine for segment-scored records and paired experiments."""

__version__ = "0.1.0"
