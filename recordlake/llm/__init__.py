"""Operators for preparing language-model training text: packing, filtering, deduplication, extraction, output files."""
