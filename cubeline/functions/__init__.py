"""Column functions: calendar buckets, axes and metrics."""
