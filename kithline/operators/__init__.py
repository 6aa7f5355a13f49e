"""Operators on DataFrames of entities, pairs, edges and decisions."""
