"""Architecture-quality analytics over per-file source metrics, on Spark."""
