"""Spark-first analytics and retrieval engine."""
