"""Functions of columns: arithmetic, text, time, expressions, user functions."""
