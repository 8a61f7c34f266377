"""kelpie: a Spark-native engine for experiment stores, data quality and pipeline analytics."""

__version__ = "0.1.0"
