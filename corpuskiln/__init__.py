"""Corpus analytics on Spark: text, relational, window, sampling and streaming operators as DataFrame transformations."""
