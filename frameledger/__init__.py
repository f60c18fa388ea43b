"""A Spark-native analytics engine for visual-inspection data."""
