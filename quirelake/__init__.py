"""Notes and documents at scale on Spark."""
