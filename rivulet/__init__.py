"""Versioned key-value changelogs as Spark tables."""
