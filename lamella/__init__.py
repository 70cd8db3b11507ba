"""Multi-resolution N-dimensional arrays as relational data on Spark."""
