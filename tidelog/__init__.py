"""Spark-first change-log analytics: every operator maps DataFrames to DataFrames."""
