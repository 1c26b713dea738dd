"""Operators over tables: selection, joins, aggregates, windows, reshaping, statistics."""
