"""Log-structured Parquet tables on Spark."""
