"""Whole dataflows: indexing and search."""
