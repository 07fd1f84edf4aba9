"""Scalar functions on nucleotides, strands and counts, as Columns."""
