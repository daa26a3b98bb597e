"""Paired-comparison evaluation and event-trace analytics on Spark DataFrames."""
