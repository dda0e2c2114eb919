"""A Spark-native engine over a corpus of text: registry, chunks, vectors, graph."""
