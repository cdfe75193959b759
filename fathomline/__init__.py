"""Spark-native forecasting, value-analysis and corpus operators."""
