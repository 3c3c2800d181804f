"""marlstone: a Spark-native engine for evidence graphs, retrieval, bitemporal tables and training-data preparation."""
