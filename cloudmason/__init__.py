"""cloudmason: Spark-first analytics over labelled 3D point clouds of buildings."""

__version__ = "0.1.0"
