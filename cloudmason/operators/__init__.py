"""cloudmason.operators."""
