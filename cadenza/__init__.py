"""Cadenza: a semantic analytics engine on Spark DataFrames."""
