"""Column-level helpers: pure expressions, no jobs."""
