"""Rankloom: keyed, insertion-ordered tables and ranked similarity search on Spark DataFrames."""
