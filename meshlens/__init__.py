"""meshlens: a Spark-native analytics engine for property graphs of software systems."""

__version__ = "0.1.0"
