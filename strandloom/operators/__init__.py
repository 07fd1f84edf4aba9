"""Relational operators on reads, positions, regions and features; each takes and gives DataFrames."""
