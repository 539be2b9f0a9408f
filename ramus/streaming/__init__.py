"""Clusters kept up to date over a stream of points."""
