"""Snapshot comparison, dependency graphs and corpus operators on PySpark."""
