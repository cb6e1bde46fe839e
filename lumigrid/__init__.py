"""Similarity analytics on Spark: hybrid search, ground truth, evaluation and feature extraction as DataFrame plans."""
