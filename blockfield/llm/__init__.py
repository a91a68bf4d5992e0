"""Corpus operators for training data over the project's artifacts, token streams and coefficient blocks."""
