"""Spark-native reconciliation of drawing callouts with model elements."""
