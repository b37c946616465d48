"""cloudmason.sources."""
