"""Operators on tables: corpus statistics, vectors, search, scores, graphs."""
