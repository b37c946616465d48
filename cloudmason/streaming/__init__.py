"""cloudmason.streaming."""
