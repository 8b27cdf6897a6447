"""Grained aggregates over streams."""
