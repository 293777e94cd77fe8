"""Benign-only anomaly detectors trained and applied as Spark jobs."""
