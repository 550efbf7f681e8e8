"""Memory-quality analytics on Spark: facts, stores and probe logs in, scored DataFrames out."""
