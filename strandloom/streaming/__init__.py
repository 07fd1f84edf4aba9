"""Counts over reads that keep arriving.

Counts by position are sums, so a pileup over a stream of alignments is a streaming aggregation with no
state but the counts themselves. No watermark applies: a position may be covered again at any time.
"""
