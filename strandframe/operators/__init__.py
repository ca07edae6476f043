"""Operators on tables of pairs and of sequence sets."""
