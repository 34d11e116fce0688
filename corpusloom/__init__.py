"""Corpus preparation, many-queries-at-once retrieval, grounding and evaluation on Spark DataFrames."""
