"""Spark-native analytics for sparse spatiotemporal count panels and probabilistic forecasts."""
