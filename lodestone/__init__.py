"""Lodestone: feature extraction over code and text as Spark DataFrames."""
