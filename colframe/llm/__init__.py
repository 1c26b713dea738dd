"""Training-data operators: fingerprints, tokenizing, dedup, filters, mixing.

Nothing else in ``colframe`` imports this subpackage.  ``registry`` holds the
queries and their SQL.
"""
