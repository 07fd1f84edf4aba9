"""Readers of alignments, sequences, regions, features and variants, and the writers of results."""
