"""Spark-native analytics for cohorts of free-text records."""
