"""Genomic read analytics on Spark."""
