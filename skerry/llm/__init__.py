"""Operators for preparing text corpora: fusion, chunking, deduplication, search, cleaning, weighting, packing, mixing, quality."""
