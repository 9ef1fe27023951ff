"""A Spark-native analytics engine for text knowledge bases."""
