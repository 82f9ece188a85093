"""Batch-to-quality analytics as Spark DataFrame operators."""
