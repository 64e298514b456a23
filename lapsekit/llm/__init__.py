"""Operators for large training corpora: near-duplicates, packing, archives, scoring, token files."""
