"""Subtitle evidence analytics at archive scale, on Spark DataFrames."""
