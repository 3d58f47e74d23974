"""PySpark-native document, graph, retrieval and instruction-data engine."""
