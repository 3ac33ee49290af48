"""Catalogue-image audit engine on Spark DataFrames."""
