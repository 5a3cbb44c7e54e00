"""Spark-native analytics over job-posting observations."""
