"""A Spark-native engine for match events, player tracking and text corpora."""
