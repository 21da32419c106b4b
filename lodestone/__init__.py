"""Hybrid retrieval, evidence checking and evaluation as PySpark DataFrame operators."""
