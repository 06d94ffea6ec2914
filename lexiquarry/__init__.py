"""A Spark-native engine for building, inspecting, searching and scoring text corpora."""
