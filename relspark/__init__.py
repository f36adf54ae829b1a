"""A Spark-native engine to build and evaluate retrieval benchmarks."""
