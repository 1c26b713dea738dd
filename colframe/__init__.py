"""A Spark-native analytics engine with a dataframe-style surface."""
