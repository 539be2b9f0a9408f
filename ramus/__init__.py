"""Ramus: hierarchical clustering and vector analytics on PySpark."""
