"""Occurrence-density tiles, and the preparation of large text corpora, on Spark."""
