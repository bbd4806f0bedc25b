"""Readers, writers and file registration."""
