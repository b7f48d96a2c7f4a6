"""A Spark-native engine for retrieval and text analytics: chunk, rank, fuse, cite, verify, repair, filter, split, measure."""
