"""Spark engine that measures which statistics of a return series tell real data from synthetic data."""
