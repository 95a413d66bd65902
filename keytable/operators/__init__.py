"""Operators on DataFrames: indexes, relations, writes, revisions, spatial search."""
