"""quaesta: a Spark-native engine for scoring, checking and cleaning short free-text answers."""

__version__ = "0.1.0"
