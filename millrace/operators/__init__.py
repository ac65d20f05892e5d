"""Changes of stored tables."""
