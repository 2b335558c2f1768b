"""A Spark-native engine that prepares document collections: sources, cleaning, chunking, structuring and sinks."""
