"""Structured Streaming versions of the online operators."""
