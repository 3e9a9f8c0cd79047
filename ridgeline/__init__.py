"""Shape-similarity and ranking analytics on Apache Spark."""
