"""Streaming of the record engine."""
