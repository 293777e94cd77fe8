"""Readers, text and frame decoders, writers."""
