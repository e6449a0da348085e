"""Span-label text analytics on Spark DataFrames."""
