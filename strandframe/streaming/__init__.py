"""Alignment of sequences as they arrive."""
