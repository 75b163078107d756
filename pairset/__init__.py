"""Curation and evaluation of paired-sample datasets on Spark DataFrames."""
