"""Operators over DataFrames of points, pairs, clusters, sequences and graphs."""
