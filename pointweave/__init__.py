"""pointweave: Spark-native analytics for tissue point data."""
