"""Response-quality analytics on PySpark: grading, features, sampling, statistics and reports."""
