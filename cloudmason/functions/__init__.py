"""cloudmason.functions."""
