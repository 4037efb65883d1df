"""Column functions: text, time, and numeric expressions built from Spark SQL functions."""
