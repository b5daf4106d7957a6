"""Quarry: retrieval, text and analytics operators on Spark DataFrames."""
