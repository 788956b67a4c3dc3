"""A Spark-native analytics engine for source-code property graphs."""
