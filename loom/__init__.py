"""loom: Spark-native operators for building and analysing training data."""
