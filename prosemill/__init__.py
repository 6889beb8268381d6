"""Prose quality and training data, measured and improved for whole corpora on Spark."""
