"""Readers and writers of text and binary point, sequence, graph and mesh files."""
