"""Filters, aggregates and windows."""
