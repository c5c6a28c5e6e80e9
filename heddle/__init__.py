"""Spark-first analytics over web pages and text corpora."""
