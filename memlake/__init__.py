"""A Spark-native memory-analytics engine: drawers, vector and lexical search, temporal graph, ingest."""
