"""Kithline: entity resolution, graph analytics and corpus preparation on Spark DataFrames."""
