"""Pair retrieval and pair learning over Spark DataFrames."""
