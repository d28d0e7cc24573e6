"""Operators for training-data corpora: text, URL, vector and archive work as Spark jobs."""
