"""Readers, writers and databases."""
