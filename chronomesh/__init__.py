"""Temporal interaction graphs as Spark DataFrames."""
