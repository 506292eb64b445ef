"""Timed-text passages and hybrid retrieval as plain Spark DataFrame operators."""
