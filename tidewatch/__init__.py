"""Spark-native analytics over operational logs, outages and health events."""
