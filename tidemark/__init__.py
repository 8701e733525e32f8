"""Tidemark: leakage-safe temporal analytics over trade fills and documents, on PySpark."""
