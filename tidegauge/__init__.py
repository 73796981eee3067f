"""PySpark-native analytics for time-series signals and compressed columns."""
