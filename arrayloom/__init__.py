"""A Spark-native archive and transform engine for large multi-run numeric arrays."""
