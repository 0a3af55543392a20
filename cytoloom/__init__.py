"""Spark-first analytics for bisulfite sequencing."""
