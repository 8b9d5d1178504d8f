"""Spatio-temporal track analytics on PySpark."""
